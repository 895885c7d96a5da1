"""Language identification by rank-order profiles.

A language's profile is its PROFILE most frequent character n-grams (1 to 3 letters, with the blanks around words), most
frequent first. A document's own most frequent n-grams are held against each profile: every n-gram costs the difference of its
two ranks, or PROFILE if the language lacks it, and the language with the smallest sum wins (ties: the smaller name). The
score is the winner's share when the mean costs are turned into weights that fall off exponentially.

Profiles are learned from about SAMPLE labelled documents of each language, chosen by a hash of id and text; every document,
whole, is then judged in one pass without a shuffle.

Nulls: a null text, or one without a letter, is `und` with score 0; a null label teaches nothing; a null id hashes as the text
"null". With nothing to learn from, all are `und`. Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import in_tasks, set_aside, table

PROFILE, LONGEST = 400, 3
#: Labelled documents of each language that its profile is learned from, about.
SAMPLE = 3000
#: Profiles are sent to every worker, 5 KB a language. With more labels than this the column holds no languages, and learning raises an error.
LANGUAGES = 10_000
SHARPNESS = 30.0
UNDECIDED = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams and how often each occurs; none if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(points):
        return points, points
    letter = _is_letter()[points]
    if not letter.any():
        return points[:0], points[:0]
    padded = np.concatenate([[0], np.where(letter, points, 0), [0]])
    padded = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]
    codes, found = padded, [padded[padded != 0]]
    for _ in range(LONGEST - 1):
        if len(codes) < 2:
            break
        codes = (codes[:-1] << 21) | padded[len(padded) - len(codes) + 1 :]
        found.append(codes)
    return np.unique(np.concatenate(found), return_counts=True)


def _top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:n]]


def learn(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE, languages: int = LANGUAGES) -> dict[str, list[int]]:
    """Profiles by language from labelled rows (doc_id, text, lang)."""
    labelled = docs.where("lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = [(r["lang"], min(1.0, sample / r["n"])) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()]
    if not sizes:
        return {}
    if len(sizes) > languages:
        raise ValueError(f"lang holds more than {languages} labels")
    rates = docs.sparkSession.createDataFrame(sizes, "lang string, _rate double")
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.withColumn("_draw", draw).join(F.broadcast(rates), "lang").where("_draw < _rate")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, defaultdict] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = totals[lang]
                for code, n in zip(*(x.tolist() for x in ngrams(text)), strict=True):
                    own[code] += n
        for lang, own in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    grams = in_tasks(chosen.select("text", "lang"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    profiles: dict[str, list[int]] = defaultdict(list)
    for r in ranked.orderBy("lang", "rank").collect():
        profiles[r["lang"]].append(r["gram"])
    return dict(profiles)


class Judge:
    def __init__(self, profiles: dict[str, list[int]], profile: int = PROFILE):
        self.names, self.most = sorted(profiles), profile
        entries = [(code, k, rank) for k, name in enumerate(self.names) for rank, code in enumerate(profiles[name])]
        codes, language, rank = np.array(sorted(entries), np.int64).reshape(-1, 3).T
        self.language, self.rank = language.astype(np.int32), rank.astype(np.int32)
        self.codes, self.at, self.n = np.unique(codes, return_index=True, return_counts=True)

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not len(self.codes):
            return UNDECIDED, 0.0
        own = _top(codes, counts, self.most)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == own)
        at, n = self.at[at[known]], self.n[at[known]]
        entry = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)  # the languages that hold each n-gram
        spared = self.most - np.abs(self.rank[entry] - np.repeat(known, n))
        cost = (self.most * len(own) - np.bincount(self.language[entry], spared, len(self.names))) / len(own) / self.most
        best = int(np.argmin(cost))
        return self.names[best], float(1 / np.exp(SHARPNESS * (cost[best] - cost)).sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """docs with _lang and _score, all other columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    names, text = docs.columns, docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(sent.value)
        for batch in batches:
            found = [own(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "_lang", "_score"])

    schema = docs.select("*", F.lit("").cast("string").alias("_lang"), F.lit(0.0).alias("_score")).schema
    return in_tasks(docs, judge, schema)


def keep_identified(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The documents in a known language (one of `languages`, if given), with their own columns."""
    safe, back = set_aside(docs)
    judged = identify(safe, learn(docs.where(~held_out(F.col("doc_id")))))
    kept = judged.where(F.col("_lang") != UNDECIDED if languages is None else F.col("_lang").isin(languages))
    return kept.select(*back)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


QUERIES = {"op8_language": op8_language}
