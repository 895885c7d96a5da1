"""Splits, samples and balanced subsets, by ranks of a seeded hash so that every run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.sources.shared import cut, numbered


def seeded(key: Column, seed: str) -> Column:
    """A draw in [0, 2**32) for each key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def stratified_sample(clips: DataFrame, key: str, bins: list[str], total: int, least: int, seed: str = "42") -> DataFrame:
    """Exactly `total` rows if there are as many: `least` of each bin, of what remains of the total each bin its share, rounded down, as far as it has rows, and then any
    rows in the order of the draw up to the total. If the least of all bins is more than the total, the last in that order go.

    Rows are put in the order of bin and draw over ranges, and a bin's first place in that order gives the places inside it, so no bin is one task.
    """
    draw = seeded(F.col(key), seed)
    drawn = cut(numbered(clips.withColumn("_draw", draw), [*bins, "_draw", key]), "drawn")
    sizes = drawn.groupBy(*bins).agg(F.count("*").alias("_size"), F.min("_idx").alias("_start"))
    summed = sizes.agg(F.sum("_size").alias("_all"), F.sum(F.least(F.col("_size"), F.lit(least))).alias("_base"))
    base = F.least(F.col("_size"), F.lit(least))
    more = F.floor(F.greatest(F.lit(total) - F.col("_base"), F.lit(0)) * F.col("_size") / F.col("_all"))
    quota = sizes.crossJoin(F.broadcast(summed)).select(*bins, "_start", F.least(F.col("_size"), base + more).alias("_quota"))
    same = [F.col(f"c.{b}").eqNullSafe(F.col(f"q.{b}")) for b in bins]
    marked = drawn.alias("c").join(quota.alias("q"), same).select("c.*", (F.col("_idx") - F.col("_start") < F.col("_quota")).alias("_in"))
    marked = cut(marked.drop("_idx"), "quotas")
    n = marked.where("_in").count()
    if n < total:
        more_rows = numbered(marked.where("NOT _in"), ["_draw", key]).where(F.col("_idx") < total - n)
        return marked.where("_in").select(*clips.columns).unionByName(more_rows.select(*clips.columns))
    return numbered(marked.where("_in"), ["_draw", key]).where(F.col("_idx") < total).select(*clips.columns)


def build_splits(clips: DataFrame, tags: DataFrame, bins: list[str], validation: int, train: int, least: int, ratio: float | None = None, excluded: DataFrame | None = None, seed: str = "42") -> DataFrame:
    """clip_id and split of the clips (clip_id, scene) that have answers (tags: clip_id and bins) and whose scene is not excluded.

    A stratified sample is for validation, `train` of the others, or all if there are fewer, for training; the rest is left out. With a ratio, that share of
    the clips, rounded down, is for validation and all others for training.
    """
    kept = clips if excluded is None else clips.join(excluded.select("scene").distinct(), "scene", "left_anti")
    able = cut(tags.join(kept.select("clip_id").distinct(), "clip_id", "left_semi"), "eligible")
    if ratio is not None:
        n = able.count()
        validation, train = int(n * ratio), n - int(n * ratio)
    chosen = cut(stratified_sample(able, "clip_id", bins, validation, least, seed).select("clip_id"), "validation")
    rest = able.select("clip_id").join(chosen, "clip_id", "left_anti").withColumn("_draw", seeded(F.col("clip_id"), f"{seed}-train"))
    trained = numbered(rest, ["_draw", "clip_id"]).where(F.col("_idx") < train)
    return chosen.withColumn("split", F.lit("val")).unionByName(trained.select("clip_id", F.lit("train").alias("split")))


def split(clips: DataFrame, key: str, validation: DataFrame) -> DataFrame:
    """clips with split: val for those in the validation table, else train."""
    val = validation.select(key).distinct().withColumn("_val", F.lit(True))
    return clips.join(val, key, "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def imbalance(answers: DataFrame, question: str = "question_id", answer: str = "answer") -> DataFrame:
    """For each question the largest distance of an answer's share from an even share."""
    counts = answers.groupBy(question, answer).agg(F.count("*").alias("n"))
    w = Window.partitionBy(question)
    off = F.abs(F.col("n") / F.sum("n").over(w) - 1 / F.count("*").over(w))
    return counts.withColumn("off", off).groupBy(question).agg(F.max("off").alias("imbalance"))


#: Candidates of a pick: so many of the wanted class, in the order of the draw.
CANDIDATES = 500


def candidate_queues(answers: DataFrame, size: int, candidates: int, seed: str) -> DataFrame:
    """The clips that a selection of `size` can come to: of each class and source, and of each source, the first size + candidates in the order of the draw. clip_id, source, draw, answers.

    A pick looks at the first candidates of a queue that are not chosen yet, and at most `size` clips are chosen in all, so nothing beyond is ever looked at.
    """
    clips = answers.groupBy("clip_id").agg(F.coalesce(F.min("source"), F.lit("")).alias("source"), F.map_from_entries(F.array_distinct(F.array_agg(F.struct("question_id", "answer")))).alias("answers"))
    drawn = clips.withColumn("draw", seeded(F.col("clip_id"), seed))
    queues = drawn.select("clip_id", "source", "draw", F.explode(F.concat(F.map_entries("answers"), F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))))).alias("_q"))
    place = F.row_number().over(Window.partitionBy("_q", "source").orderBy("draw", "clip_id"))
    kept = queues.withColumn("_place", place).where(F.col("_place") <= size + candidates).select("clip_id").distinct()
    return drawn.join(kept, "clip_id", "left_semi").select("clip_id", "source", "draw", "answers")


def greedy_picks(pool, classes: dict[str, list[str]], size: int, candidates: int, most: dict[str, int]) -> list[int]:
    """Rows of the pool (source, answers; in the order of the draw) one by one.

    Each pick serves the question that is furthest from even shares, and in it the class that lacks most (ties: the first by name). Of the first candidates with that answer
    it takes the one that helps the other questions most: the sum of what its classes lack there, ties to the first. Sources at their cap are left
    aside; if none has the answer, all clips of open sources are candidates.
    """
    import numpy as np

    questions = sorted(classes)
    at = {(q, a): k for k, (q, a) in enumerate((q, a) for q in questions for a in sorted(classes[q]))}
    span = {q: [at[q, a] for a in sorted(classes[q])] for q in questions}
    fair = np.concatenate([[1.0 / len(span[q])] * len(span[q]) for q in questions]) if questions else np.zeros(0)
    own = np.full((len(pool), len(questions)), -1)
    for r, answers in enumerate(pool["answers"]):
        for k, q in enumerate(questions):
            own[r, k] = at.get((q, dict(answers).get(q)), -1)
    source, free = pool["source"].to_numpy(), np.ones(len(pool), bool)
    count, taken, picks = np.zeros(len(fair)), dict.fromkeys(most, 0), []
    while len(picks) < size and questions:
        total = {q: count[span[q]].sum() for q in questions}
        off = [1.0 if not total[q] else round(float(np.abs(count[span[q]] / total[q] - fair[span[q]]).max()), 9) for q in questions]
        worst = int(np.argmax(off))
        lack = np.concatenate([np.round(fair[span[q]] - count[span[q]] / max(total[q], 1), 9) for q in questions])
        wanted = span[questions[worst]][int(np.argmax(lack[span[questions[worst]]]))]
        open_ = free & np.array([taken.get(x, 0) < most.get(x, size) for x in source], bool)
        found = np.flatnonzero(open_ & (own[:, worst] == wanted))[:candidates]
        if not len(found):
            found = np.flatnonzero(open_)[:candidates]
        if not len(found):
            break
        helps = np.where(own[found] >= 0, np.maximum(lack[own[found]], 0), 0)
        helps[:, worst] = 0
        best = int(found[np.argmax(np.round(helps.sum(1), 9))])
        picks.append(best)
        free[best] = False
        taken[source[best]] = taken.get(source[best], 0) + 1
        count[own[best][own[best] >= 0]] += 1
    return picks


def balanced_subset(answers: DataFrame, size: int, seed: str = "42", candidates: int = CANDIDATES, least: dict[str, float] | None = None) -> DataFrame:
    """clip_id and pick (from 1) of up to `size` clips (clip_id, source, question_id, answer), each picked for the class that is then most wanted.

    Every pick depends on all before it, so one task picks; all it is given are the heads of the queues of each class and source, whose number is bounded by `size`, not by the clips.
    least: for a source, the share of the selection that must stay open to it: the others are capped at the rest.
    """
    known = answers.where("clip_id IS NOT NULL AND question_id IS NOT NULL AND answer IS NOT NULL")
    if "source" not in known.columns:
        known = known.withColumn("source", F.lit(None).cast("string"))
    classes: dict[str, list[str]] = {}
    for r in known.select("question_id", "answer").distinct().collect():
        classes.setdefault(r.question_id, []).append(r.answer)
    pool = candidate_queues(known, size, candidates, seed)
    shares = least or {}
    open_to = {s: -(-int(round(share * size * 1e9)) // 10**9) for s, share in shares.items()}

    def pick(own):
        import pandas as pd

        own = own.sort_values(["draw", "clip_id"]).reset_index(drop=True)
        most = {s: size - sum(n for o, n in open_to.items() if o != s) for s in own["source"].unique()}
        picks = greedy_picks(own, classes, size, candidates, most)
        return pd.DataFrame({"clip_id": own["clip_id"].iloc[picks].to_numpy(), "pick": range(1, len(picks) + 1)})

    kind = answers.schema["clip_id"].dataType.simpleString()
    return pool.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(pick, f"clip_id {kind}, pick int")


def normalised_entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of the counts n of each group over the largest it could have; 0 for a lone class."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    g = counts.withColumn("_p", p).groupBy(*keys).agg(F.sum(-F.col("_p") * F.log("_p")).alias("_h"), F.count("*").alias("_k"))
    return g.select(*keys, F.when(F.col("_k") <= 1, 0.0).otherwise(F.col("_h") / F.log(F.col("_k").cast("double"))).alias("entropy"))


def least_digests(df: DataFrame, group: str, digest: Column, k: int) -> DataFrame:
    """The rows of df that can be among a group's k least distinct digests (hexadecimal, nulls last): a few more than those, all of a group with fewer digests.

    Rows fall into 4,096 slots by digits that do not decide the order. Digests of different slots differ, so the k-th least of the slots' least ones
    bounds the k least of all. Only the slots are held and sent, a number each; no task puts its rows in order.
    """
    most = F.lit((1 << 63) - 1)
    rows = df.withColumns({"_at": F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), most), "_slot": F.coalesce(F.conv(F.substring(digest, 16, 3), 16, 10).cast("int"), F.lit(-1))})
    least = rows.groupBy(group, "_slot").agg(F.min("_at").alias("_at")).groupBy(F.col(group).alias("_group")).agg(F.sort_array(F.collect_list("_at")).alias("_least"))
    bounds = least.select("_group", F.coalesce(F.try_element_at("_least", F.lit(k)), most).alias("_bound"))
    return rows.join(F.broadcast(bounds), F.col(group).eqNullSafe(F.col("_group"))).where("_at <= _bound").select(*df.columns)
