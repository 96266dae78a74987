"""Languages of documents and of the segments of mixed ones.

The script of a word narrows its candidate languages.  Within a script that
several languages use, a word has a score for each: its likelihood in a model
fitted on a bounded sample of labelled rows (labels are dirty, so the model is
refitted on what it says itself of each sentence), or that of its letter trigrams
where the sample lacks it.  A Viterbi search over the words, with a penalty for
switching at the end of a sentence, a higher one where the script changes within
one and none allowed elsewhere, labels whole sentences; neighbours of one
language are a segment.  Code, JSON, paths, ids, labels of speakers and front
matter are blanked beforehand and end no segment.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm.labels import LANGUAGES, language_of

#: Labelled rows of each table that the model is fitted on, at most: those of the least hashes.
SAMPLE_ROWS = 4_000
#: Characters of a sampled row that the fit looks at (labelling looks at whole texts).
SAMPLE_CHARS = 3_000
#: Rounds of refitting on the model's own labels.
REFITS = 2
#: Penalties of switching language at the end of a sentence, and where the script changes within one.
SWITCH, SWITCH_WITHIN = 3.0, 14.0
#: A score is never lower than this a word; that of a word in a script the language doesn't use.
FLOOR, FOREIGN = -6.0, -4.0
#: Below this lead over the next language a sentence is no evidence.
LEAD = 1.5

_AT = {code: i for i, code in enumerate(LANGUAGES)}
#: Scripts, the languages that use them, and letters that weigh as much as a word.
SCRIPTS = {
    "latin": (["en", "de", "fr", "es", "pt"], None), "cyrillic": (["ru", "uk"], None), "thai": (["th"], 4), "hangul": (["ko"], 3),
    "arabic": (["ar"], None), "devanagari": (["hi"], None), "kana": (["ja"], 1), "han": (["ja", "zh"], 1),
}
_SCRIPT_NAMES = list(SCRIPTS)
#: What a Han character says against Japanese, which mixes it with kana.
HAN_JA = -0.7

_BLANK = regex.compile(
    r"""(?P<front>\A\s*---[ \t]*\r?\n(?:.*\r?\n)*?---[ \t]*(?=\r?\n|\Z))
    |(?P<fence>```(?:.*\n?)*?(?:```|\Z))
    |(?P<tag></?[A-Za-z][^<>\n]*+>|<\|[^|\n]*+\|>)""",
    regex.X,
)
_LINE_BLANK = regex.compile(
    r"""^[ \t>*\-]*(?:
      \#{1,6}[ \t].*                                              # headings
    | \[tool_?use[^\]]*\].*                                         # tool calls
    | (?:\[[\w ]+\][ \t]*)?(?:
        \$[ \t].* | [\{\[]["\{\[].* | \d+\t.* | \d+[ \t]*\|.*       # shell, JSON, numbered and table rows
      | [\w.\-]*/[\w./\-]+:\d+:.* | [\w.]+\([^()\n]*\)[ \t]*;?[ \t]*$  # matches in files, calls
      | (?:const|let|var|def|class|import|return|function)[ \t]+\w+[ \t]*[=({:].*
      | [\w\-]+:[ \t]*[\w\-.\#]+[ \t]*$ )                           # key: value
    )""",
    regex.X | regex.M,
)
_LABEL = regex.compile(r"^[ \t>*\-]*(?:\[\d{1,2}:\d\d(?::\d\d)?\][ \t]*(?:[\w.\-]+:)?|\[[\w ]+\]|(?:user|assistant|human|agent|model|system|tool|bot)[ \t]*:)", regex.M | regex.I)
_INVISIBLE = regex.compile(r"[​-‏⁠﻿]")
#: ASCII runs with digits, or marks that words don't have: ids, paths, addresses.
_ID = regex.compile(r"[!-~]*[0-9_/@\\=][!-~]*")
_SENTENCE = regex.compile(r"[^.!?…。！？।؟\n\r\x0b\x0c\x85  ]*(?:[.!?…]+[\"'”»)*_]*(?=\s|$)|[。！？।؟]+[」』\"'”)*_]*|[.!?…]+|[\n\r\x0b\x0c\x85  ]|$)")
_WORD = regex.compile(
    r"(?P<latin>\p{Latin}[\p{Latin}\p{M}'’]*)|(?P<cyrillic>\p{Cyrillic}[\p{Cyrillic}\p{M}'’]*)|(?P<thai>[\p{Thai}]+)|(?P<hangul>[\p{Hangul}]+)"
    r"|(?P<arabic>\p{Arabic}[\p{Arabic}\p{M}]*)|(?P<devanagari>[\p{Devanagari}]+)|(?P<kana>[\p{Hiragana}\p{Katakana}ー]+)|(?P<han>\p{Han}+)"
)
_END = regex.compile(r"[.!?…。！？।؟]")


@dataclass
class Unit:
    """A sentence, or the part of one in scripts that go together."""

    start: int
    stop: int
    words: list[tuple[str, str]] = field(default_factory=list)  # (script, word)
    first: bool = True  # begins a sentence
    closed: bool = False  # has a mark that ends a sentence


def _spaces(m: regex.Match) -> str:
    return regex.sub(r"[^\n]", " ", m[0])


def plain_text(text: str) -> str:
    """The text with everything that has no language blanked, offsets kept."""
    if "---" in text or "```" in text or "<" in text:
        text = _BLANK.sub(_spaces, text)
    text = _LINE_BLANK.sub(lambda m: " " * len(m[0]), text.replace("\r", "\n"))
    text = _LABEL.sub(lambda m: " " * len(m[0]), text)
    return text


def _family(script: str) -> str:
    return "cjk" if script in ("kana", "han") else script


def units_of(text: str) -> list[Unit]:
    """The sentences of a text with their words, in reading order."""
    plain, places = plain_text(text), None
    if _INVISIBLE.search(plain):
        # joined for the ids; places says where each character was
        kept = [(c, i) for i, c in enumerate(plain) if not _INVISIBLE.match(c)]
        plain, places = "".join(c for c, _ in kept), [i for _, i in kept]
    plain = _ID.sub(lambda m: " " * (len(m[0]) - 1) + (m[0][-1] if m[0][-1] in ".!?" else " "), plain)
    units = []
    for sentence in _SENTENCE.finditer(plain):
        if sentence.end() == sentence.start():
            continue
        closed = bool(_END.search(sentence[0]))
        unit = None
        for m in _WORD.finditer(sentence[0]):
            script = m.lastgroup
            at, end = sentence.start() + m.start(), sentence.start() + m.end()
            word = m[0]
            if not any(map(str.isalpha, word)):  # digits and marks of a script
                continue
            if script in ("latin", "cyrillic"):
                word = unicodedata.normalize("NFC", word).lower().replace("’", "'")
            if unit is None or _family(unit.words[-1][0]) != _family(script):
                unit = Unit(at, end, first=unit is None, closed=closed)
                units.append(unit)
            unit.words.append((script, word))
            unit.stop = end
    if places is not None:
        for unit in units:
            unit.start, unit.stop = places[unit.start], places[unit.stop - 1] + 1
    return units


class Model:
    """Scores of words: for each a row with a number a language, 0 for the best.
    `temperature` divides scores before they are made probabilities, see calibrate."""

    temperature = 1.0

    def __init__(self, words: dict[str, dict[str, Counter]]) -> None:
        self.words, self.grams, self.rows = {}, {}, {}
        for script, by_language in words.items():
            candidates = SCRIPTS[script][0]
            grams = {c: Counter() for c in candidates}
            for c in candidates:
                for word, n in by_language.get(c, {}).items():
                    for g in self._grams(word):
                        grams[c][g] += min(n, 3)
            self.words[script] = self._log(candidates, {c: by_language.get(c, Counter()) for c in candidates}, 0.2)
            self.grams[script] = self._log(candidates, grams, 0.5)

    @staticmethod
    def _grams(word: str) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    @staticmethod
    def _log(candidates: list[str], counts: dict[str, Counter], smooth: float) -> dict[str, list[float]]:
        kinds = set().union(*counts.values())
        totals = {c: sum(counts[c].values()) + smooth * (len(kinds) + 1) for c in candidates}
        return {k: [math.log((counts[c][k] + smooth) / totals[c]) for c in candidates] for k in kinds}

    def row(self, script: str, word: str) -> np.ndarray:
        key = (script, word)
        if (found := self.rows.get(key)) is not None:
            return found
        candidates, letters = SCRIPTS[script]
        weight = 1.0 if letters is None else max(1.0, len(word) / letters)
        row = np.full(len(LANGUAGES), FOREIGN * weight)
        if script == "han":
            row[_AT["ja"]], row[_AT["zh"]] = HAN_JA * weight, 0.0
        elif len(candidates) == 1:
            row[_AT[candidates[0]]] = 0.0
        else:
            logs = self.words.get(script, {}).get(word)
            if logs is None:
                grams = [g for x in self._grams(word) if (g := self.grams.get(script, {}).get(x))]
                logs = [sum(g[i] for g in grams) / 2 for i in range(len(candidates))]
            best = max(logs)
            for c, x in zip(candidates, logs):
                row[_AT[c]] = max(FLOOR, x - best)
        if len(self.rows) > 300_000:
            self.rows.clear()
        self.rows[key] = row
        return row

    def scores(self, units: list[Unit]) -> np.ndarray:
        return np.array([sum(self.row(s, w) for s, w in u.words) for u in units])


def is_sentence(unit: Unit, scores: np.ndarray) -> bool:
    """Says something of its language: a lead, and where no mark ends it more than
    stray words."""
    top = np.partition(scores, -2)[-2:]
    if top[1] - top[0] < LEAD:
        return False
    words = {w for _, w in unit.words}
    return unit.closed or unit.words[0][0] not in ("latin", "cyrillic") or len(words) > 5 or sum("'" not in w for w in words) > 2


def viterbi(scores: np.ndarray, penalties: list[float]) -> list[int]:
    """The best language of each row of scores (a word, or a sentence whose words' scores
    are summed); penalties[i] is that of switching before row i.  Where a switch is ruled
    out, as inside a sentence, words may be summed first: the best path is the same."""
    best = scores[0].copy()
    back = []
    for row, penalty in zip(scores[1:], penalties[1:]):
        top = int(best.argmax())
        switch = best[top] - penalty
        stay = best >= switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, switch) + row
    at = int(best.argmax())
    path = [at]
    for step in reversed(back):
        at = int(step[at])
        path.append(at)
    return path[::-1]


def segments(text: str | None, model: Model) -> list[tuple[str, float, int, int]]:
    """(language, confidence, start, stop) of each segment, in reading order."""
    units = units_of(text) if text else []
    if not units:
        return []
    scores = model.scores(units)
    telling = [is_sentence(u, s) for u, s in zip(units, scores)]
    kept = [(u, s) for u, s, t in zip(units, scores, telling) if t]
    if not kept:
        return []
    units, scores = [u for u, _ in kept], np.array([s for _, s in kept])
    path = viterbi(scores, [SWITCH if u.first else SWITCH_WITHIN for u in units])
    out, begin = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[begin]:
            total = scores[begin:i].sum(axis=0)
            others = np.exp(np.clip((np.delete(total, path[begin]) - total[path[begin]]) / model.temperature, -50, 50)).sum()
            out.append((LANGUAGES[path[begin]], float(1 / (1 + others)), units[begin].start, units[i - 1].stop))
            begin = i
    return out


def fit(samples: list[tuple[str, str]]) -> Model:
    """A model from (text, language of the label)."""
    read = [(units_of(text[:SAMPLE_CHARS]), language) for text, language in samples]

    def count(labelled: Iterator[tuple[Unit, str]]) -> Model:
        words: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for unit, language in labelled:
            for script, word in unit.words:
                if len(SCRIPTS[script][0]) > 1 and script != "han" and language in SCRIPTS[script][0]:
                    words[script][language][word] += 1
        return Model(words)

    model = count((u, language) for units, language in read for u in units)
    for _ in range(REFITS):
        model = count((u, LANGUAGES[int(s.argmax())]) for units, _ in read if units for u, s in zip(units, model.scores(units)) if is_sentence(u, s))
    model.temperature = calibrate(model, [units for units, _ in read])
    return model


def calibrate(model: Model, texts: list[list[Unit]]) -> float:
    """The temperature at which the confidence in a single sentence is most like how
    often it is of the language of all other sentences of its text, by log loss."""
    leads, right = [], []
    for units in texts:
        if len(units) < 3:
            continue
        scores = model.scores(units)
        for i, unit in enumerate(units):
            if is_sentence(unit, scores[i]):
                rest = scores.sum(axis=0) - scores[i]
                at = int(scores[i].argmax())
                leads.append(np.delete(scores[i], at) - scores[i][at])
                right.append(int(rest.argmax()) == at)
    if not leads:
        return 1.0
    apart, hit = np.array(leads), np.array(right)

    def loss(temperature: float) -> float:
        sure = np.clip(1 / (1 + np.exp(np.clip(apart / temperature, -50, 50)).sum(axis=1)), 1e-6, 1 - 1e-6)
        return float(-np.where(hit, np.log(sure), np.log1p(-sure)).mean())

    return min((0.5 * 1.25**k for k in range(24)), key=loss)


def fit_sample(tables: list[DataFrame]) -> Model:
    """The model of a bounded sample: of each table (id, text, label) the
    SAMPLE_ROWS rows with a label that names a language whose ids hash least."""
    rows = []
    for df in tables:
        known = df.select("id", F.substring("text", 1, SAMPLE_CHARS).alias("text"), language_of(F.col("label")).alias("lang"))
        known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        # so few hashes pass that the driver never sees many more rows than it keeps
        n = df.where(language_of(F.col("label")).isNotNull()).count()
        if n > 4 * SAMPLE_ROWS:
            known = known.where(F.pmod(F.xxhash64("id"), F.lit(n)) < 2 * SAMPLE_ROWS)
        rows += known.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE_ROWS).select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def label_segments(df: DataFrame, model: Model) -> DataFrame:
    """Segments of the rows of df (tab, id, text, label): tab, id, seg, lang,
    confidence, start, stop, label.

    A row without segments (null, empty, nothing but code) gives none.  Repeated
    rows are labelled each, texts of any length whole.  The model is bounded by its
    sample and broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.words, model.grams, model.temperature))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model({})
        own.words, own.grams, own.temperature = shared.value
        for frame in frames:
            out = []
            for tab, id_, label, text in zip(frame["tab"], frame["id"], frame["label"], frame["text"]):
                for seg, (lang, confidence, start, stop) in enumerate(segments(text, own)):
                    out.append((tab, id_, seg, lang, confidence, start, stop, label))
            yield pd.DataFrame(out, columns=["tab", "id", "seg", "lang", "confidence", "start", "stop", "label"])

    slim = df.select("tab", F.col("id").cast("long").alias("id"), "label", "text")
    return slim.mapInPandas(run, "tab string, id long, seg int, lang string, confidence double, start int, stop int, label string")


def wrongly_labelled(found: DataFrame) -> DataFrame:
    """Of label_segments' rows those of texts with several segments, or whose label
    doesn't name their language: tab, id, seg, lang."""
    case = found.where((F.col("seg") > 0) | ~language_of(F.col("label")).eqNullSafe(F.col("lang")))
    cases = case.select("tab", "id").distinct().withColumnsRenamed({"tab": "_tab", "id": "_id"})
    joined = found.join(cases, (F.col("tab") == F.col("_tab")) & (F.col("id") == F.col("_id")), "left_semi")
    return joined.select("tab", "id", F.col("seg").cast("long").alias("seg"), "lang")


def inputs(documents: DataFrame, event_rows: DataFrame, lang_labels: DataFrame) -> list[DataFrame]:
    """The two tables that are looked at, each as tab, id, text, label."""
    docs = documents.select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    labels = lang_labels.select(F.col("row_no").alias("_row"), F.col("lang").alias("label"))
    rows = event_rows.select("row_no", "text").join(labels, F.col("row_no") == F.col("_row"))
    return [docs, rows.select(F.lit("event_rows").alias("tab"), F.col("row_no").alias("id"), "text", "label")]
