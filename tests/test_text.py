import pytest
from pyspark.sql import functions as F

from skeinlake.functions import text as T
from skeinlake.operators import filters as P


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<channel source="a" user="u" chat_id="1">hi</channel>', ("a", "1", "u", "hi")),
        ('  <channel source="a" source="b" user="u">x <b>y</b>', ("a", "", "u", "x <b>y</b>")),
        ('<channel source="a" user="u', ("a", "", "", "")),
        ("<channel>hi</channel>", None), ('<channel user="u">hi', None), ("<channel-id> is needed", None), ('said <channel source="a">', None), ("", None), (None, None),
    ],
)
def test_channel(spark, text, want):
    f = T.channel_facets(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(f.alias("f"), T.strip_envelope(F.col("t")).alias("body")).first()
    assert (got["f"] and (got["f"]["via"], got["f"]["chat_id"], got["f"]["from_user"], got["body"])) == want


def test_paths(spark):
    c = F.col("p")
    assert one(spark, T.tree_key_of(c), p="/r/p/u/subagents/workflows/wf_1/agent-2.jsonl") == "subagents/workflows/wf_1/agent-2.jsonl".join(["u/", ""])
    assert one(spark, T.tree_key_of(c), p="/r/p/u/subagents/a.jsonl") == "u/subagents/a.jsonl"
    assert one(spark, T.tree_key_of(c), p="/r/p/u.jsonl") == "u.jsonl"
    assert one(spark, T.repo_key_of(c), p="/x/github.com/o/r.wt-fix/src") == "github.com/o/r"
    assert one(spark, T.repo_key_of(c), p="/x/incubate/worktrees/o/r/src") == "github.com/o/r"
    assert one(spark, T.repo_key_of(c), p="/x/y") is None
    assert tuple(one(spark, T.context_of(c), p="/x/github.com/o/r/agents/7/src")) == ("agents/7", "agents/7/src")
    assert tuple(one(spark, T.context_of(c), p="/x/github.com/o/r.wt-fix/src")) == ("wt-fix", "src")
    assert one(spark, T.remote_to_key(c), p="git@github.com:o/r.git") == "github.com/o/r"
    assert one(spark, T.remote_to_key(c), p="https://user@gitlab.com/o/r/") == "gitlab.com/o/r"
    assert one(spark, T.encode_project_dir(c), p="/a/b.c") == "-a-b-c"
    assert one(spark, T.encode_omp_dir(c), p="/a/b") == "--a-b--"
    assert one(spark, T.ephemeral_hint(c), p="see /private/tmp/claude-501/x") == "structural"
    assert one(spark, T.ephemeral_hint(c), p="see /tmp/x") == "weak"
    assert one(spark, T.ephemeral_hint(c), p="/var/tmpfiles") is None


def test_names(spark):
    name = T.name_of(F.col("t"), F.col("d"))
    assert one(spark, name, t=" Title ", d="x") == "Title"
    assert one(spark, name, t="", d="<command-name>/fix</command-name><command-args> a  b </command-args>") == "/fix a b"
    assert one(spark, name, t=None, d="<environment_context> x") == "(untitled)"
    assert one(spark, name, t=None, d=None) == "(untitled)"
    assert one(spark, name, t=None, d='<channel source="a">do\nit</channel>') == "do it"
    assert len(one(spark, name, t=None, d="w " * 100)) <= T.MAX_NAME


def test_noise(spark):
    rule = T.noise_rule(F.col("t"), F.col("r"))
    listing = "".join(f"{i}\tline of a file\n" for i in range(1, 60))
    assert one(spark, rule, t=listing, r="tool_result") == "file-readback"
    assert one(spark, rule, t=listing, r="user") == ""
    assert one(spark, rule, t="[tool_use Edit] {}", r="tool_use") == "edit-payload"
    assert one(spark, rule, t="[tool_use Grep] {}", r="tool_use") == "navigation-call"
    assert one(spark, rule, t="x " + "QUJD" * 40, r="tool_result") == "binary-blob"
    assert one(spark, rule, t="a/" * 100, r="tool_result") == "binary-blob"
    assert one(spark, rule, t='[tool_result] {"total_tokens": 1}', r="tool_result") == "harness-bookkeeping"


def test_turns_and_labels(spark):
    assert one(spark, T.is_harness_turn(F.col("t")), t="<system-reminder> x")
    assert one(spark, T.is_inbound_turn(F.col("t")), t=" Continue from where you left off. ")
    assert not one(spark, T.is_harness_turn(F.col("t")), t="continue please")
    assert one(spark, T.duration_label(F.col("n")), n=3_725_000) == "1h02m"
    assert one(spark, T.snippet(F.col("t"), "NEEDLE"), t="hay " * 50 + "the needle\nhere").count("needle") == 1
    assert one(spark, T.truncate(F.col("t"), 3), t="abcdef") == "abc...[+3]"


@pytest.mark.parametrize(
    ("text", "want"),
    [("สวัสดีครับ ok", "th"), ("we use the word ภาษา in it now and", "th+en"), ("What is this and that", "en"), ("src/a_b.py 123", "latin"), ("日本語です", "zh/ja"), ("한국어", "ko"), ("привет мир", "cyrillic"), ("123 !", "none"), ("", "none")],
)
def test_language_class(spark, text, want):
    assert one(spark, T.language_class(F.col("t")), t=text) == want


def test_scopes():
    assert P.content_terms("How does the Cache work for the cache") == ["Cache", "work"]
    assert P.parse_roles("chat, system") == ["user", "assistant", "system"]
    assert P.to_iso("2026-09-01", True) == "2026-09-01T23:59:59.999Z"
    assert P.to_iso("2026-09-01T10:00:00+07:00") == "2026-09-01T03:00:00.000Z"
    assert P.facet_argument(12.0) == "12"
    for bad in (True, None, "", " ", 1.5, 2**60):
        with pytest.raises(ValueError):
            P.facet_argument(bad)
