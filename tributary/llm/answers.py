"""Problem 7: defective answers to questions.

Three small models are fitted first: a character trigram naive Bayes of languages (from a bounded sample of labelled
documents, about ``LANGUAGE_ROWS`` rows a language), the likelihood that a text ends after a word n-gram (from all
reference answers and the short complete forms of ``COMPLETE``), and a classifier of declining sentences
(``refusals``). Each answer then goes through one pass: emptiness, restated question, refusal, language against the
question's, and the likelihood of its ending; only code that is left open is found without a model.

Defined results: a null answer is empty; with a null or empty question an answer is neither copied nor in
another language; of several defects the first of empty, copied, refusal, other_language, truncated is
given; an answer after a restated question is judged by itself. Rows with a null result id are left out.
An empty table gives no rows, and without samples the models decide nothing. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import latest_version
from ..queries.tables import table
from .refusals import REFERENCE_ROWS, Refusals

LANGUAGE_ROWS = 2_000
HELD_CONTEXTS = 200_000
BUCKETS = 1 << 16
#: An answer whose likelihood to end where it does is below this is cut off.
LEAST_LIKELY = 0.03
#: Words seen less often than this, and in endings less often than half as likely as the above, are as unseen ones.
LEAST_SEEN = 200
#: Weight of the short complete forms beside all reference answers.
COMPLETE_SHARE = 0.2
#: Texts of fewer tokens are a context as a whole.
SHORT = 13
COMPLETE = [
    "`a`", "a_b", "Yes", "No", "True", "False", "None", "Sí", "Si", "Oui", "Non", "Ja", "Nein", "7", "1,204", "3.5", "12%", "-3", "`a`, `b`", "`a`, `b`, `c`", "`a` -> `b`", "`a` -> `b` -> `c`", "`a` and `b`",
    "- `a`", "- `a`\n- `b`", "- `a` (x.py)", "- `a` (x.py)\n- `b` (y.py)", "1. `a`\n2. `b`", "- a_b: 3",
]

# Texts that stand for no answer, compared without case and marks.
PLACEHOLDERS = {"", "null", "none", "nil", "na", "n/a", "nan", "empty", "no output", "no answer", "answer", "no response", "undefined", "tbd", "todo", "blank"}
ERROR_NOTICE = re.compile(r"^\W*(?:error|exception|traceback|internal error|fatal)\b\s*[:(\]]", re.I)
INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯⠀ㅤ﻿ﾠ]+")

CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
QUOTED = re.compile(r"`[^`\n]*`?|„[^“”\n]*[“”]|“[^”\n]*”|«[^»\n]*»|\"[^\"\n]*\"|(?<!\w)'[^'\n]+'(?!\w)|\S*[_/\\]\S*|\S*\d\S*")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+")
WORD = re.compile(r"`[^`\n]*`|\w+|[^\w\s]")
_BLANKS = re.compile(r"\s+")
LETTERS = re.compile(r"[^\W\d_]", re.U)

# First and last code points of scripts other than Latin.
SCRIPTS = [(0x370, 0x3FF), (0x400, 0x52F), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)]


def prose(text: str | None) -> str:
    """The running text: without code, quotations, identifiers, paths and numbers, in lower case."""
    return _BLANKS.sub(" ", QUOTED.sub(" ", CODE.sub(" ", text or ""))).strip().lower()


# ---- language ------------------------------------------------------------------------------------


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all character trigrams, each text padded with blanks."""
    padded = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded])
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    bucket = ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(BUCKETS)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    return owner[:-2][inside], bucket[inside]


class Languages:
    """Naive Bayes over hashed character trigrams; texts in a script other than Latin are of that script."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).T.astype(np.float64) if len(names) else np.zeros((BUCKETS, 0))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihoods by language, number of letters, script: -1 for Latin) of each text."""
        owner, bucket = _trigrams(texts)
        out = np.stack([np.bincount(owner, weights=self.table[bucket, k], minlength=len(texts)) for k in range(len(self.names))], axis=1) if self.names else np.zeros((len(texts), 0))
        letters, script = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -1)
        for i, text in enumerate(texts):
            if text.isascii():
                letters[i] = len(text) - text.count(" ")
                continue
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letters[i] = int((codes > 0x40).sum())
            for k, (lo, hi) in enumerate(SCRIPTS):
                if 2 * int(((codes >= lo) & (codes <= hi)).sum()) > letters[i]:
                    script[i] = k
        return out, letters, script


def _language_label(column: str):
    return F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)


def _sample(df: DataFrame, rows: int, key: str, by: str | None = None) -> DataFrame:
    """About ``rows`` rows of each group, by a threshold on the hash of the key: nothing is sorted or gathered."""
    scale = 1 << 30
    if by is None:
        share = min(1.0, rows / max(1, df.count()))
        return df.filter(F.pmod(F.xxhash64(key), F.lit(scale)) < int(share * scale))
    # labels are two or three letters: 18,252 rows at most
    counts = df.groupBy(by).agg((F.least(F.lit(1.0), rows / F.count("*")) * scale).alias("__most"))
    return df.join(F.broadcast(counts), by).filter(F.pmod(F.xxhash64(key), F.lit(scale)) < F.col("__most")).drop("__most")


def fit_languages(documents: DataFrame, rows: int = LANGUAGE_ROWS, least: int = 5) -> Languages:
    """Counts of trigrams by language over a bounded sample of labelled texts; labels with few texts are left out."""
    held = documents.select("doc_id", _language_label("lang").alias("label"), "text").filter("label not in ('', 'und') and length(text) > 0")
    sample = _sample(held, rows, "doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        texts_of: Counter = Counter()
        for batch in batches:
            labels = batch.column(0).to_pylist()
            owner, bucket = _trigrams([prose(t) for t in batch.column(1).to_pylist()])
            for label in set(labels):
                mine = np.array([x == label for x in labels])
                texts_of[label] += int(mine.sum())
                totals[label] = totals.get(label, 0) + np.bincount(bucket[mine[owner]], minlength=BUCKETS)
        for label, count in totals.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(used) + 1)), pa.array([*used.tolist(), -1], pa.int32()), pa.array([*count[used].tolist(), texts_of[label]], pa.int64())], names=["label", "bucket", "n"])

    rows_ = sample.select("label", "text").mapInArrow(run, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    enough = sorted(rows_[(rows_["bucket"] == -1) & (rows_["n"] >= least)]["label"])
    counts = np.zeros((len(enough), BUCKETS))
    for k, label in enumerate(enough):
        mine = rows_[(rows_["label"] == label) & (rows_["bucket"] >= 0)]
        counts[k, mine["bucket"].to_numpy(dtype=np.int64)] = mine["n"].to_numpy(dtype=float)
    return Languages(enough, counts)


# ---- endings -------------------------------------------------------------------------------------


def end_classes(text: str) -> list[str]:
    """Tokens of a text from its start mark on: identifiers and numbers as classes, line ends and list items marked."""
    out = ["<s>"]
    for k, line in enumerate(text.strip().split("\n")):
        item = _ITEM.match(line)
        if k:
            out.append("<nl>")
        if item:
            out.append("<item>")
            line = line[item.end() :]
        for token in WORD.findall(line):
            if token[0] == "`":
                token = "<id>" if len(token) > 1 and token[-1] == "`" else "<open>"
            elif "_" in token:
                token = "<id>"
            elif token.isdigit():
                token = "<n>"
            out.append(("-" if item else "") + token.lower())
    return out


def _kind(token: str) -> str:
    """What a token counts as where it was not seen: by list item or not, a word, a class or a mark."""
    item, bare = token[1:2] and token[0] == "-", token.lstrip("-")
    return ("<item> " if item else "") + (bare if bare[:1] == "<" else "<word>" if bare[:1].isalnum() else "<mark>")


def _contexts(tokens: list[str], i: int) -> list[str]:
    """The contexts of token i, its kind first."""
    found = ["kind\t" + _kind(tokens[i]), tokens[i], f"{tokens[i - 1]}\t{tokens[i]}"]
    return [*found, "whole\t" + "\t".join(tokens[1 : i + 1])] if i < SHORT else found


class Endings:
    """Likelihood that a text ends after its last tokens: the best of what its last one, its last two and, if it is short, all give."""

    def __init__(self, counts: dict[str, tuple[float, float]], weight: float = 4.0):
        self.counts, self.weight = counts, weight

    def likelihood(self, tokens: list[str]) -> float:
        ended, seen = self.counts.get("kind\t" + _kind(tokens[-1]), (0, 0))
        base = (ended + self.weight / 2) / (seen + self.weight)
        best = None
        for context in _contexts(tokens, len(tokens) - 1)[1:]:
            ended, seen = self.counts.get(context, (0, 0))
            if seen:
                best = max(best or 0.0, (ended + self.weight * base) / (seen + self.weight))
        return base if best is None else best


def _ending_counts(texts: list[str], seen: Counter, ended: Counter, weight: float = 1, only_whole: bool = False) -> None:
    for text in texts:
        tokens = end_classes(text)
        if len(tokens) > 1:
            for counter, of in ((seen, range(1, len(tokens))), (ended, (len(tokens) - 1,))):
                for i in of:
                    for context in _contexts(tokens, i)[3 if only_whole else 0 :]:
                        counter[context] += weight


def fit_endings(answers: DataFrame) -> Endings:
    """End counts of token n-grams over all complete answers; contexts that end no text, or too few to decide, stay with the executors.

    What is kept is at most three contexts a text, and of those only the ones that make an ending likely.
    """
    whole = answers.filter("length(text) > 0").select("text")

    def rows(seen: Counter, ended: Counter, texts: int) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([*keys, ""], pa.string()), pa.array([*(ended[k] for k in keys), 0], pa.int64()), pa.array([*(seen[k] for k in keys), texts], pa.int64())], names=["context", "ended", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ended: Counter = Counter()
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            _ending_counts(batch.column(0).to_pylist(), seen, ended)
            if len(seen) > HELD_CONTEXTS:
                yield rows(seen, ended, texts)
                seen, ended, texts = Counter(), Counter(), 0
        yield rows(seen, ended, texts)

    counts = whole.mapInArrow(run, "context string, ended bigint, seen bigint").groupBy("context").agg(F.sum("ended").alias("ended"), F.sum("seen").alias("seen"))
    # marks, and words that are seen often, are known even if they end no text; all else only matters where it makes an ending likely
    single = ~F.col("context").contains("\t") & (~F.col("context").rlike(r"^-?[\p{L}\p{N}]") | (F.col("seen") >= LEAST_SEEN))
    counts = counts.filter((F.col("context") == "") | F.col("context").startswith("kind\t") | (F.col("ended") >= LEAST_LIKELY / 2 * F.col("seen")) | single)
    held = {c: (float(e), float(s)) for c, e, s in counts.toPandas().itertuples(index=False)}
    texts = held.pop("", (0, 0))[1]
    seen, ended = Counter({c: s for c, (_, s) in held.items()}), Counter({c: e for c, (e, _) in held.items()})
    _ending_counts(COMPLETE, seen, ended, max(1.0, COMPLETE_SHARE * texts / len(COMPLETE)), only_whole=True)
    return Endings({c: (ended[c], n) for c, n in seen.items()})


# ---- one answer ----------------------------------------------------------------------------------

_LABEL = re.compile(r"^\s*(?:--?|—|–|:)?\s*(?:answer|antwort|réponse|respuesta)?\s*:?\s*", re.I)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = INVISIBLE.sub(" ", answer).strip()
    if ERROR_NOTICE.match(bare):
        return True
    core = re.sub(r"^[\W_]+|[\W_]+$", "", bare).lower()
    if core in PLACEHOLDERS:
        # "None." is a sentence, "None" is what a program prints
        return not (core in ("none", "nil") and bare.endswith("."))
    return False


def _plain_words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def without_question(answer: str, question: str | None) -> tuple[str, bool]:
    """What follows the restated question, and whether the answer is nothing but the question, perhaps altered."""
    asked = _plain_words(question or "")
    if not asked:
        return answer, False
    while True:
        given = _plain_words(answer)
        if given[: len(asked)] != asked:
            break
        spot = next(itertools.islice(re.finditer(r"\w+", answer), len(asked) - 1, None)).end()
        rest = _LABEL.sub("", re.sub(r"^[`'\"”“).,;:?!\]]*", "", answer[spot:]), count=1)
        if not re.search(r"[^\W_]", rest):
            return "", True
        if len(asked) < 4:  # an answer may begin with the few words of a short question
            return answer, False
        answer = rest
    if len(asked) < 4 or len(given) < 4:
        return answer, "".join(asked) == "".join(given)
    count = Counter(asked)
    common = sum((Counter(given) & count).values())
    if common < 0.55 * len(given) or common < 0.45 * len(asked):
        return answer, False
    # misspelt words of the question count as its words
    left = list((count - Counter(given)).elements())
    extra = list((Counter(given) - count).elements())
    bags = [Counter(x) for x in left]
    strange = 0
    for word in extra:
        bag = Counter(word)
        best = min(range(len(left)), key=lambda i: ((bags[i] - bag) + (bag - bags[i])).total(), default=-1)
        if best >= 0 and ((bags[best] - bag) + (bag - bags[best])).total() <= max(2, len(word) // 5):
            left.pop(best)
            bags.pop(best)
        else:
            strange += 1
    covered = 1 - len(left) / len(asked)
    return answer, strange <= max(2, 0.12 * len(given)) and covered >= 0.6


def is_truncated(answer: str, endings: Endings) -> bool:
    text = answer.rstrip()
    if not text:
        return False
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    if text.rsplit("\n", 1)[-1].count("`") % 2:
        return True
    return endings.likelihood(end_classes(text)) < LEAST_LIKELY


def defect_of(answer: str | None, question: str | None, endings: Endings, refusals: Refusals) -> tuple[str | None, str]:
    """(defect but for the language, the part of the answer to judge the language of)."""
    if is_empty(answer):
        return "empty", ""
    rest, copied = without_question(answer, question)
    if copied:
        return "copied", ""
    if refusals.refuses(rest, question):
        return "refusal", ""
    return ("truncated" if is_truncated(rest, endings) else None), rest


def fit_refusals(answers: DataFrame) -> Refusals:
    """The classifier of declining sentences, with a bounded sample of (question, text) as statements."""
    sample = _sample(answers.filter("length(text) > 0"), REFERENCE_ROWS, "text").groupBy("text").agg(F.min("question").alias("question"))
    return Refusals(sorted((r["question"] or "", r["text"]) for r in sample.collect()))


def defects(results: DataFrame, languages: Languages, endings: Endings, refusals: Refusals, least_letters: int = 24) -> DataFrame:
    """(result_id, defect) of every defective row of (result_id, question, model_answer)."""
    shared = results.sparkSession.sparkContext.broadcast((languages, endings, refusals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, endings, refusals = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                questions = batch.column("question").to_pylist()
                found, parts = [], []
                for answer, question in zip(batch.column("model_answer").to_pylist(), questions):
                    defect, part = defect_of(answer, question, endings, refusals)
                    found.append(defect)
                    parts.append(prose(part) if question else "")
                own, letters, script = languages.scores(parts)
                asked, asked_letters, asked_script = languages.scores([prose(q) for q in questions])
                if len(languages.names) > 1:
                    a, q = own.argmax(axis=1), asked.argmax(axis=1)
                    row = np.arange(len(parts))
                    sure = (own[row, a] - own[row, q] > np.maximum(8.0, 0.12 * letters)) & (asked[row, q] - asked[row, a] > 4.0)
                else:
                    sure = np.zeros(len(parts), dtype=bool)
                foreign = np.where((script >= 0) | (asked_script >= 0), (script != asked_script) & (letters >= 6), sure & (letters >= least_letters)) & (asked_letters >= 12)
                for i in np.flatnonzero(foreign):
                    if found[i] in (None, "truncated"):
                        found[i] = "other_language"
                spot = [i for i, d in enumerate(found) if d]
                yield pa.RecordBatch.from_arrays([batch.column("result_id").take(pa.array(spot, pa.int64())), pa.array([found[i] for i in spot], pa.string())], names=["result_id", "defect"])

    return results.select(F.col("result_id").cast("bigint").alias("result_id"), "question", "model_answer").mapInArrow(run, "result_id bigint, defect string")


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    results = table(spark, sf_dir, "qa_results")
    held = latest_version(results.select("result_id", "question", "model_answer", "model", "context_mode", "ingested_ts"), "result_id").filter("result_id is not null")
    languages = fit_languages(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    endings = fit_endings(results.select(F.col("reference_answer").alias("text")))
    refusals = fit_refusals(results.select("question", F.col("reference_answer").alias("text")))
    return held, defects(held, languages, endings, refusals)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[1]


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and defects of each kind by model and context mode."""
    held, found = _found(spark, sf_dir)
    whole = held.select("result_id", "model", "context_mode").join(found, "result_id", "left")
    kinds = ["empty", "truncated", "refusal", "copied", "other_language"]
    return whole.groupBy("model", "context_mode").agg(F.count("*").alias("answers"), *[F.count_if(F.col("defect") == k).alias(k) for k in kinds], F.round(F.count("defect") / F.count("*"), 6).alias("defective"))


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
