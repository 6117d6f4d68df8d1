"""Frame lookups, rankings, exports and selections (FLT-*, TOP-*, AGG-*, PIP-*)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.views import ALIASES, RELATIONS, ROLES, participations


def find_by_entity(frames: DataFrame, entity: str) -> DataFrame:
    """FLT-03: frames in which any role is exactly the entity."""
    hit = participations(frames).where(F.col("filler_key") == text.key(F.lit(entity))).select("frame_id")
    return frames.join(hit, "frame_id", "left_semi")


def find_by_kriya(frames: DataFrame, kriya: str) -> DataFrame:
    """FLT-04."""
    return frames.where(text.key(F.col("kriya")) == text.key(F.lit(kriya)))


def role_name(alias: str) -> str | None:
    return next((r for r, names in ALIASES.items() if alias.lower() in names), None)


def find_by_role(frames: DataFrame, role: str, value: str) -> DataFrame:
    """FLT-05: frames whose role contains the value, in any case; an unknown role finds none."""
    name = role_name(role)
    return frames.where(F.contains(F.lower(F.col(name)), F.lit(value.lower())) if name else F.lit(False))


def shown_roles(frames: DataFrame) -> DataFrame:
    """FLT-06: a map of the roles that are filled."""
    roles = F.create_map(*[x for r in ROLES for x in (F.lit(r), F.col(r))])
    return frames.select("frame_id", F.map_filter(roles, lambda k, v: v.isNotNull() & (v != "")).alias("roles"))


def match_all(edges: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """FLT-12/13: frames that have every (role, entity); a role without a relation matches nothing."""
    out = edges.select("src").distinct()
    for role, entity in wanted:
        rel = RELATIONS.get(role)
        hit = edges.where((F.col("relation") == F.lit(rel)) & (F.col("dst") == entity)) if rel else edges.where(F.lit(False))
        out = out.join(hit.select("src").distinct(), "src", "left_semi")
    return out


def keyword_score(kriya_words: list[str], entity_words: list[str], sentence: Column) -> Column:
    """TOP-01: 3 if the action holds a keyword, 2 for each entity keyword in the sentence or the joined roles."""
    acts = F.lit(0)
    if kriya_words:
        hit = F.lit(False)
        for w in kriya_words:
            hit = hit | F.contains(F.lower("kriya"), F.lit(w.lower()))
        acts = F.when(F.coalesce(hit, F.lit(False)), 3).otherwise(0)
    joined = F.lower(F.concat_ws(" ", "karta", "karma", "sampradana", "locus_time", "locus_space"))
    for w in entity_words:
        found = F.contains(F.lower(sentence), F.lit(w.lower())) | F.contains(joined, F.lit(w.lower()))
        acts = acts + F.when(F.coalesce(found, F.lit(False)), 2).otherwise(0)
    return acts


def keyword_rank(frames: DataFrame, kriya_words: list[str], entity_words: list[str], fallback: bool = False) -> DataFrame:
    """TOP-01/02: scored frames; ``fallback``: all frames with score 0 if none is hit."""
    said = text.canonical_text({c: F.col(c) for c in ("karta", "kriya", "karma", "karana", "locus_topic")})
    scored = frames.withColumn("score", keyword_score(kriya_words, entity_words, said))
    hits = scored.where("score > 0")
    if not fallback:
        return hits
    any_hit = hits.select(F.lit(1).alias("hit")).limit(1)
    return hits.union(scored.join(any_hit, F.lit(True), "left_anti"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """WIN-05/06, TOP-09: the first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Rows and queries that are compared in one task, and queries at once within it.
ROWS, ASKED, AT_ONCE = 8192, 2048, 256


def _best(k: int, metric: str):
    """The k nearest rows of a block for each query of a block: a matrix product finds the candidates, the distances of
    these are summed component by component like ``text.squared_distance`` and ``text.cosine``."""

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        v = table[name].combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def norms(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])

    def run(_, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "d": []}
        if rows.num_rows and asked.num_rows:
            ids, names, x, q = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy(), matrix(rows, "v"), matrix(asked, "v")
            nx, nq = norms(x), norms(q)
            for at in range(0, len(q), AT_ONCE):
                part, n = q[at : at + AT_ONCE], nq[at : at + AT_ONCE]
                near = part @ x.T
                near = n[:, None] ** 2 + nx**2 - 2 * near if metric == "l2" else -near / (n[:, None] * nx)
                near[names[at : at + AT_ONCE, None] == ids] = np.inf
                most = np.partition(near, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(part), np.inf)
                # far more than what rounding can do
                most = most + 1e-9 * (n**2 + nx.max() ** 2 if metric == "l2" else 1)
                for i, name in enumerate(names[at : at + AT_ONCE]):
                    found = np.flatnonzero((near[i] <= most[i]) & (ids != name))
                    y = x[found]
                    if metric == "l2":
                        d = np.cumsum((y - part[i]) * (y - part[i]), axis=1)[:, -1]
                    else:
                        d = -(np.cumsum(y * part[i], axis=1)[:, -1] / (nx[found] * n[i]))
                    first = np.lexsort((ids[found], d))[:k]
                    out["query_id"].append(np.full(len(first), name))
                    out["vec_id"].append(ids[found][first])
                    out["d"].append(d[first])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.float64() if c == "d" else pa.int64()) for c, v in out.items()})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """TOP-03/04: the k nearest vectors of every query, itself left out, among all rows.

    ``queries`` is a stated set.  Blocks of rows meet blocks of queries, so the work grows with rows times queries but a
    task's does not.  Vectors of another length than most, with null, non-finite or very large components, or (cosine)
    a norm of about zero are compared by expressions: whose distance is null comes first.
    """
    v = vectors.select(F.col("vec_id").alias("id"), "embedding").where("id is not null")
    usual = v.groupBy(F.size("embedding").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").first()
    v = v.withColumn("v", F.col("embedding").cast("array<double>"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    plain = F.coalesce((F.size("v") == (usual["size"] if usual else 0)) & (length < 1e100) & (length >= (0.0 if metric == "l2" else 1e-100)), F.lit(False))
    v = v.withColumn("plain", plain)
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding").where("query_id is not null").withColumn("v", F.col("embedding").cast("array<double>")).withColumn("plain", plain)
    n_rows, n_asked = max(1, -(-v.count() // ROWS)), max(1, -(-q.count() // ASKED))
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    rows = v.where("plain").select(F.col("id").cast("bigint").alias("vec_id"), "v", dealt("id", n_rows).alias("r"), some(n_asked).alias("s"))
    asked = q.where("plain").select(F.col("query_id").cast("bigint").alias("query_id"), "v", dealt("query_id", n_asked).alias("s"), some(n_rows).alias("r"))
    near = rows.groupBy("r", "s").cogroup(asked.groupBy("r", "s")).applyInArrow(_best(k, metric), "query_id bigint, vec_id bigint, d double")
    d = text.squared_distance(F.col("v.embedding"), F.col("q.embedding")) if metric == "l2" else -text.cosine(F.col("v.embedding"), F.col("q.embedding"))
    odd = lambda a, b: a.alias("v").join(b.alias("q"), F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), d.alias("d"))
    near = near.union(odd(v.where("not plain"), q)).union(odd(v.where("plain"), q.where("not plain")))
    return top_per(near, ["query_id"], [F.col("d"), F.col("vec_id")], k).select("query_id", "vec_id", "rank")


def graph_edges(frames: DataFrame) -> DataFrame:
    """SRC-07: an edge from each frame to each filled role's entity, with display labels."""
    p = participations(frames)
    return p.select("frame_id", "role", "filler_key", F.initcap("filler_key").alias("entity_label"))


def select_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """PIP-04/TOP-08: the candidate of the highest mean valid score (1 if none is valid), the first at ties."""
    ok = F.filter(F.transform("scores", lambda x: F.when(x.between(1, 100), x)), lambda x: x.isNotNull())
    mean = F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda s, x: s + x) / F.size(ok)).otherwise(F.lit(1.0))
    scored = candidates.withColumn("score", mean)
    return top_per(scored, keys, [F.col("score").desc(), F.col("pos")]).drop("rank")


def upserted(frames: DataFrame, new: DataFrame) -> DataFrame:
    """PIP-01: frames with the new ones added or put in place of those with their id; indexes are views of this table,
    so none can be stale.  ``new`` holds each id once."""
    return frames.join(new.select("frame_id"), "frame_id", "left_anti").unionByName(new, allowMissingColumns=True)


def cleared(frames: DataFrame) -> DataFrame:
    """PIP-02: the empty table of the same columns."""
    return frames.limit(0)


def answer_rows(questions: DataFrame, found: DataFrame) -> DataFrame:
    """PIP-13: ``question_id, status, n`` of ``questions(question_id, problem)`` with ``found(question_id)`` frames: ERROR
    if the question has a problem, GROUNDED if frames were found, else NO_MATCH."""
    n = found.groupBy("question_id").agg(F.count("*").alias("n"))
    status = F.when(F.col("problem").isNotNull(), "ERROR").when(F.col("n") > 0, "GROUNDED").otherwise("NO_MATCH")
    return questions.join(n, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("question_id", status.alias("status"), "n")
