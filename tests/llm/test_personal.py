import pytest
from hypothesis import given, strategies as st

from skeinlake.llm import personal as P

FIRSTS, LASTS = {"noor", "ansel", "désirée", "zoë"}, {"okandu", "o'kellanby", "saint-corvin", "ångsdal"}


def sure(text):
    return {(k, text[a:b]) for k, _, _, a, b, _, seed in P.instances(text, FIRSTS, LASTS) if seed}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("to nils.m57@post.tarn.test.", {("email", "nils.m57@post.tarn.test")}),
        ("mailto:JORUN_T+logs@UNI.EXAMPLE.ORG?subject=x", {("email", "JORUN_T+logs@UNI.EXAMPLE.ORG")}),
        ("q.o at post dot tarn dot test when", {("email", "q.o at post dot tarn dot test")}),
        ("a-b (at) inbox (dot) example (dot) net now", {("email", "a-b (at) inbox (dot) example (dot) net")}),
        ("x_y [at] kiln.invalid; 3", {("email", "x_y [at] kiln.invalid")}),
        ("Cloned git@forge.example:parser/spindle.git, @tools/gutter, deploy@1.31.0, ping @ledger77 at noon", set()),
        ("text me (+44 1632 960055) first", {("phone", "+44 1632 960055")}),
        ("On-call (303) 555-0147 tonight", {("phone", "(303) 555-0147")}),
        ("+1 (202) 555-0131 | +8135550 0191 | +1202555 0164", {("phone", "+1 (202) 555-0131"), ("phone", "+8135550 0191"), ("phone", "+1202555 0164")}),
        ("0049-30-23125493, 01632 960 872, 415.555.0101", {("phone", "0049-30-23125493"), ("phone", "01632 960 872"), ("phone", "415.555.0101")}),
        ("lines 5099-5035, order 1432-1992-8, 10.32.20.7:8020, v1.60.84-rc1, #1516992198, 1756825253300, 2026-01-02 10:00:00", set()),
        ("ids 910-10-5239, 9-4778-82328-52-8, QQ 86 82 86 C, passport X4297309", {("id_number", "910-10-5239"), ("id_number", "9-4778-82328-52-8"), ("id_number", "QQ 86 82 86 C"), ("id_number", "X4297309")}),
        ("at Flat 14, 84 Cinderford Blvd, Port Quenby, ZZ5 4QX.", {("address", "Flat 14, 84 Cinderford Blvd, Port Quenby, ZZ5 4QX")}),
        ("to 69 Quillfeather Street, Apt 30, Marrowdale 99477 now", {("address", "69 Quillfeather Street, Apt 30, Marrowdale 99477")}),
        ("1167 WINNOWING ROAD, NEW ELLING, WA 99002", {("address", "1167 WINNOWING ROAD, NEW ELLING, WA 99002")}),
        ("(120/6 Soi Copperfell 1, New Brisleigh 99650)", {("address", "120/6 Soi Copperfell 1, New Brisleigh 99650")}),
        ("Tinsmithgasse 9, 99999 New Harrowick The old", {("address", "Tinsmithgasse 9, 99999 New Harrowick")}),
        ("Read lines 8-9 of the Street map module. ISO 8601-1:2019 covers it.", set()),
        ("", set()),
    ],
)
def test_unmistakable(text, want):
    assert sure(text) == want


def names(text):
    return {text[a:b] for k, _, _, a, b, *_ in P.instances(text, FIRSTS, LASTS) if k == "name"}


def test_names_that_are_proposed():
    assert "Ansel A. Okandu" in names("Ansel A. Okandu is out")
    assert "Okandu, Noor" in names("| Okandu, Noor | 3")
    assert names("that is Noor O’Kellanby's branch") == {"Noor O’Kellanby"}
    assert names("mail noor.okandu@x.example now") == set()
    assert "noor  okandu" in names("ask noor  okandu about") and "Q. Okandu" in names("to Q. Okandu.")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, u, "junk") for i, (t, u) in enumerate(rows)], "row_no long, text string, from_user string, kind string")


def test_patterns_discover_what_no_seed_knows(spark):
    rows = [(f"Ask {n} about the queue. Ref {10_000_000 + i}.", n) for i, n in enumerate(["Noor Okandu", "Ansel O'Kellanby", "Désirée Okandu", "Zoë Ångsdal"] * 4)]
    rows += [("Ask Zebulon Quarrymoor about the queue.", "Zebulon Quarrymoor"), ("zebulon quarrymoor went home", "zq17"), ("Ask the Quiet Harbor team about it.", "x"), ("The Quiet Harbor milestone moved", "")]
    rows += [(f"her social is {900 + i}-10-50{i:02d} if asked", None) for i in range(12)] + [("her social is 917175336 if asked", None), ("The stamp was 917175337 in the log.", None)] + [(f"The stamp was 9171753{i} in the log.", None) for i in range(40, 80)]
    users = spark.createDataFrame([("Noor Okandu",), ("Ansel O'Kellanby",), ("Désirée Saint-Corvin",), ("Zoë Ångsdal",), (None,), ("single",)], "display_name string")
    got = {(r["field"], r["kind"], r["value"]) for r in P.extract(frame(spark, rows), users).collect()}
    assert {("text", "name", "Zebulon Quarrymoor"), ("from_user", "name", "Zebulon Quarrymoor"), ("text", "name", "Désirée Okandu")} <= got
    assert ("text", "id_number", "917175336") in got and ("text", "id_number", "917175337") not in got
    assert not {v for _, k, v in got if k == "name" and "Quiet" in v or "Harbor" in v}


def test_redaction_and_edges(spark):
    users = spark.createDataFrame([("Noor Okandu",)], "display_name string")
    rows = [("mail a@b.example or call +44 1632 960055, a@b.example", "c@d.example"), (None, None), ("", ""), ("nothing", "x"), ("z" * 300_000 + " +44 1632 960055", None)]
    df = frame(spark, rows)
    found = P.extract(df, users)
    assert {tuple(r) for r in P.distinct_values(found).collect()} == {(0, "text", "email", "a@b.example"), (0, "text", "phone", "+44 1632 960055"), (0, "from_user", "email", "c@d.example"), (4, "text", "phone", "+44 1632 960055")}
    out = {r["row_no"]: (r["text"], r["from_user"]) for r in P.redact(df, found).collect()}
    assert out[0] == ("mail [EMAIL] or call [PHONE], [EMAIL]", "[EMAIL]") and out[1] == (None, None) and out[3] == ("nothing", "x") and len(out) == 5
    assert out[4][0].endswith("z [PHONE]")
    assert P.extract(df.limit(0), users).count() == 0 and P.extract(df, users.limit(0)).count() == 5


def test_blanks_contexts_and_labels():
    assert sure("call +1 555    123 4567.") == {("phone", "+1 555    123 4567")}
    assert sure("Passport number: ab1234567") == {("id_number", "ab1234567")} and sure("build ab1234567") == set()
    long = "w" * 5000
    assert P.patterns(f"{long} Anna B {long}", 5001, 5007) == (f"^ {long} _", f"_ {long} $", f"{long} _ {long}")
    assert "นภา  ใจดี" in {t[a:b] for t in ["คุณนภา  ใจดี มา"] for k, _, _, a, b, *_ in P.instances(t, FIRSTS, LASTS) if k == "name"}


def test_names_of_many_parts_leave_nothing(spark):
    known = ["Noor Okandu", "Ansel O\u2019Kellanby", "De\u0301sire\u0301e Okandu", "Zoë Ångsdal", "Maria Veldt"]
    users = spark.createDataFrame([(n,) for n in known], "display_name string")
    rows = [(f"Met with {n} today.", n) for n in known * 4]
    rows += [("Met with Odalys Noor Maria Okandu today.", ""), ("Met with Noor Okandu Ansel O'Kellanby today.", ""), ("met with désirée   okandu today", ""), ("Met with Desmond Noor Okandu-Veldt today.", "")]
    df = frame(spark, rows)
    found = P.extract(df, users)
    out = [r["text"] for r in P.redact(df, found).orderBy("row_no").collect()]
    assert out[20] == "Met with Odalys [NAME] today." or out[20] == "Met with [NAME] today."
    assert out[21] == "Met with [NAME] [NAME] today." and out[22] == "met with [NAME] today"
    assert "Noor" not in out[20] and "Maria" not in out[20] and all(t == "Met with [NAME] today." for t in out[:20])


def test_a_name_grows_over_known_parts():
    span = lambda a, b, v, good=False, f=False, last=False: dict(start=a, stop=b, value=v, good=good, first_known=f, last_known=last)
    chain = [span(0, 10, "Anna Maria", f=True), span(5, 16, "Maria Luisa", f=True), span(11, 22, "Luisa Smith", good=True), span(17, 28, "Smith Jones", last=True)]
    assert P.whole_names(chain) == [(0, 28, "Anna Maria Luisa Smith Jones")]
    two = [span(0, 10, "Anna Smith", good=True), span(5, 14, "Smith Ann", f=True, last=True), span(11, 20, "Ann Jones", good=True)]
    assert P.whole_names(two) == [(0, 10, "Anna Smith"), (11, 20, "Ann Jones")]


@given(st.text(alphabet="ab \n", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from(["name", "email"])), max_size=8))
def test_redaction_leaves_nothing_of_a_find_and_all_else(text, drawn):
    spans = [dict(start=a, stop=min(len(text), a + n), kind=k) for a, n, k in drawn if a < len(text)]
    out = P.masked_text(text, spans)
    hidden = {i for s in spans for i in range(s["start"], s["stop"])}
    rest = "".join(c for i, c in enumerate(text) if i not in hidden)
    assert out.replace("[NAME]", "").replace("[EMAIL]", "") == rest
    covered = P.covered(spans)
    assert all(x[1] <= y[0] for x, y in zip(covered, covered[1:])) and sum(b - a for a, b, _ in covered) == len(hidden)


def test_bloom_filter_has_every_name(spark):
    parts = [f"f:n{i}" for i in range(3000)] + [f"l:n{i}" for i in range(3000)]
    bits = P.bloom_of(spark.createDataFrame([(p,) for p in parts], "part string"))
    first, last = P.BloomSet(bits, "f:"), P.BloomSet(bits, "l:")
    assert all(f"n{i}" in first and f"n{i}" in last for i in range(3000))
    assert sum(f"x{i}" in first for i in range(3000)) < 60 and P.BloomSet(P.bloom_of(spark.createDataFrame([], "part string")), "f:").isdisjoint({"a", "b"})
