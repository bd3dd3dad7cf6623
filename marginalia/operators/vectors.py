"""Hashed text vectors and exact similarity search (VEC1-VEC4).

A vector is 48 numbers held as whole millionths (``bigint``), so dot products
are exact integers: results do not depend on partitioning or summation order.

Scale notes
-----------
* Embedding is a narrow step: one pass over the text inside the scan's tasks, which
  makes the vectors of a batch's distinct tokens at once.  Going through a term dictionary
  would shuffle every posting twice and 48 sums per chunk.
* Search works on clustered lists.  Rows with like signs towards fixed
  directions are packed into lists with a center and a radius; queries are packed
  into blocks.  A list meets a block only where the bound of some query reaches the
  threshold, is scored with one matrix product, and returns the best ``pool`` rows
  per query.  Nothing passes the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import policy as P
from marginalia.functions.joins import materialise, small
from marginalia.functions.text import blank_to_null, hash32, lookup, trigrams
from marginalia.operators.lexical import filter_corpus, top_pool
from marginalia.operators.scoring import TOKEN_BYTES, cut

# Query vectors of a block; rows of a list; heads of lists that meet a block at once.
QUERY_BLOCK = 256
LIST_ROWS = 1024
HEADS = 4096
SIGNS = 16
TOKEN_CACHE = 500_000
# Texts whose tokens are taken together.
EMBED_ROWS = 1024

ALIAS_GROUPS = {token: group for group in P.CONCEPT_GROUPS for token in group}


# --- VEC1: weighted expansion of a token dictionary ---------------------------


def stem(token: Column) -> Column:
    """Token without its first matching ending of each of three ending groups."""
    s = F.regexp_replace(token, "(?:ing|edly|ed|tion|sion|ment|ness|able|ible)$", "")
    return F.regexp_replace(F.regexp_replace(s, "ies$", "y"), "(?:es|s)$", "")


def expand_tokens(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """VEC1: ``(token, feature, w400)`` rows of each token of a dictionary."""
    tokens = tokens.select(F.col(token_col).alias("token"))
    t = F.col("token")
    s = stem(t)
    groups = {k: "|".join(v) for k, v in ALIAS_GROUPS.items()}
    group = F.split(F.coalesce(lookup(groups, t), lookup(groups, s)), r"\|")
    w = P.FEATURE_WEIGHT_400

    def feature(name: Column, kind: str) -> Column:
        return F.struct(name.alias("feature"), F.lit(w[kind]).cast("long").alias("w400"))

    none = F.array().cast("array<struct<feature:string,w400:bigint>>")
    features = F.concat(
        F.array(feature(t, "token")),
        F.when((s != "") & (s != t), F.array(feature(s, "stem"))).otherwise(none),
        F.coalesce(
            F.transform(F.filter(group, lambda a: a != t), lambda a: feature(a, "alias")), none
        ),
        F.transform(trigrams(t), lambda g: feature(F.concat(F.lit("tri:"), g), "trigram")),
    )
    return tokens.select("token", F.explode(features).alias("x")).select("token", "x.*")


def feature_dims(features: DataFrame, dims: int = P.VECTOR_DIMS) -> DataFrame:
    """``(token, dim, w400)``: every feature hashed to its three dimensions."""
    h = {k: hash32("feature", seed) for k, seed in P.HASH_SEEDS.items()}
    sign = F.when(h["sign"] % 2 == 0, 1).otherwise(-1)
    w = F.col("w400")
    spots = F.array(
        F.struct((h["primary"] % dims).alias("dim"), w.alias("w")),
        F.struct((h["secondary"] % dims).alias("dim"), (-F.floor(w / 2) * sign).alias("w")),
        F.struct((h["tertiary"] % dims).alias("dim"), (F.floor(w / 4) * sign).alias("w")),
    )
    return (
        features.select("token", F.explode(spots).alias("x"))
        .groupBy("token", F.col("x.dim").cast("int").alias("dim"))
        .agg(F.sum("x.w").cast("long").alias("w400"))
    )


# --- VEC2: text to vector -----------------------------------------------------


def _endings_off(token: str) -> str:
    for group, put in (
        (("ing", "edly", "ed", "tion", "sion", "ment", "ness", "able", "ible"), ""),
        (("ies",), "y"),
        (("es", "s"), ""),
    ):
        if token.endswith(group):
            token = token[: -max(len(e) for e in group if token.endswith(e))] + put
    return token


def _spots(name: str, weight: int, dims: int) -> list[tuple[int, int]]:
    """The three ``(dimension, amount)`` contributions of one feature."""
    at, codes, prime = {}, name.encode(), P.FNV_PRIME
    for kind, h in P.HASH_SEEDS.items():
        for byte in codes:
            h = ((h ^ byte) * prime) & 0xFFFFFFFF
        at[kind] = h
    sign = 1 if at["sign"] % 2 == 0 else -1
    return [
        (at["primary"] % dims, weight),
        (at["secondary"] % dims, -(weight // 2) * sign),
        (at["tertiary"] % dims, weight // 4 * sign),
    ]


class _TokenVectors:
    """Token vectors in 1/400ths, with a per-task store of odd ones; starts afresh when full."""

    def __init__(self, dims: int):
        self.dims, self.shared = dims, {}
        self.reset()

    def reset(self):
        self.rows, self.matrix = {}, np.zeros((1024, self.dims), dtype=np.int64)

    def _feature(self, name: str, weight: int):
        # Trigrams and aliases recur in many tokens; tokens themselves do not.
        if name not in self.shared:
            self.shared[name] = _spots(name, weight, self.dims)
        return self.shared[name]

    def row(self, token: str) -> int:
        at = self.rows.get(token)
        if at is not None:
            return at
        w, short = P.FEATURE_WEIGHT_400, _endings_off(token)
        parts = [_spots(token, w["token"], self.dims)]
        if short and short != token:
            parts.append(_spots(short, w["stem"], self.dims))
        for alias in ALIAS_GROUPS.get(token, ALIAS_GROUPS.get(short, ())):
            if alias != token:
                parts.append(self._feature(alias, w["alias"]))
        for i in range(max(1, len(token) - 2)):
            parts.append(self._feature("tri:" + token[i:i + 3], w["trigram"]))
        total = [0] * self.dims
        for spots in parts:
            for dim, amount in spots:
                total[dim] += amount
        at = len(self.rows)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[at] = total
        self.rows[token] = at
        return at

    def _spots_of(self, names: list[str], weight: int) -> tuple[np.ndarray, np.ndarray]:
        """``_spots`` of many names at once: three dimensions and three amounts each; none for an empty name."""
        data = np.frombuffer("".join(names).encode(), np.uint8).astype(np.uint64)
        length = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-length, kind="stable")
        begin, left = (np.cumsum(length) - length)[order], length[order]
        h = np.array(list(P.HASH_SEEDS.values()), np.uint64)[:, None].repeat(len(names), axis=1)
        prime, mask = np.uint64(P.FNV_PRIME), np.uint64(0xFFFFFFFF)
        for j in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -j, side="left"))  # names longer than j come first
            h[:, :n] = ((h[:, :n] ^ data[begin[:n] + j]) * prime) & mask
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        of = dict(zip(P.HASH_SEEDS, h[:, back].astype(np.int64), strict=True))
        sign, some = np.where(of["sign"] % 2 == 0, 1, -1), length > 0
        dims = np.stack([of[k] % self.dims for k in ("primary", "secondary", "tertiary")])
        return dims, np.stack([weight * some, -(weight // 2) * sign * some, weight // 4 * sign * some])

    def vectors(self, row: np.ndarray, tokens: pa.Array, n: int) -> np.ndarray:
        """Unit vectors of ``n`` texts given by their tokens ``(row, token)``; zero without tokens.

        Each distinct token is hashed once; what its features add is summed by (text, dimension).
        """
        if len(self.rows) > TOKEN_CACHE:
            self.reset()
        w, coded = P.FEATURE_WEIGHT_400, tokens.dictionary_encode()
        names = coded.dictionary.to_pylist()
        shorts, size = list(map(_endings_off, names)), max(1, len(names))
        # Short tokens and those of a concept are few; they go one by one.
        odd = np.array([len(t) < 3 or t in ALIAS_GROUPS or s in ALIAS_GROUPS for t, s in zip(names, shorts, strict=True)], bool)
        key, count = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        text, name = key // size, key % size
        total = np.zeros(n * self.dims)  # whole numbers below 2**53

        def add(texts: np.ndarray, dims: np.ndarray, amounts: np.ndarray) -> None:
            for dim, amount in zip(dims, amounts, strict=True):
                np.add(total, np.bincount(texts * self.dims + dim, amount, n * self.dims), out=total)

        own = [("" if o else t, "" if o or s == t else s) for t, s, o in zip(names, shorts, odd.tolist(), strict=True)]
        for kind, column in (("token", 0), ("stem", 1)):
            dims, amounts = self._spots_of([x[column] for x in own], w[kind])
            add(text, dims[:, name], amounts[:, name] * count)
        data = np.frombuffer("".join(x[0] for x in own).encode(), np.uint8).astype(np.int64)
        length = np.fromiter((len(x[0]) for x in own), np.int64, len(own))
        begin, many = np.cumsum(length) - length, np.maximum(length - 2, 0)
        code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        grams, which = np.unique(code, return_inverse=True)
        spots = [self._feature(f"tri:{c >> 16:c}{c >> 8 & 255:c}{c & 255:c}", w["trigram"]) for c in grams.tolist()]
        at = np.array(spots, np.int64).reshape(-1, 3, 2)
        step = 1 << 16
        for low in range(0, len(key), step):
            of, times = name[low : low + step], count[low : low + step]
            each = many[of]
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            gram = which[np.repeat(begin[of], each) + inside]
            add(np.repeat(text[low : low + step], each), at[gram, :, 0].T, at[gram, :, 1].T * np.repeat(times, each))
        total = total.reshape(n, self.dims)
        if odd.any():
            place, pick = np.cumsum(odd) - 1, odd[name]
            rows = [self.row(names[i]) for i in np.flatnonzero(odd)]  # a store that starts afresh does so before
            times = np.bincount(text[pick] * len(rows) + place[name[pick]], count[pick], n * len(rows)).reshape(n, -1)
            total += times @ self.matrix[rows].astype(np.float64)
        norm = np.sqrt((total**2).sum(axis=1))
        norm[norm == 0] = 1.0
        return (np.floor(np.abs(total) / norm[:, None] * 1e6 + 0.5) * np.sign(total)).astype(np.int64)


def hash_embed(df: DataFrame, text_col: str, out_col: str = "values", dims: int = P.VECTOR_DIMS) -> DataFrame:
    """VEC2: add the unit vector of a text's tokens, in whole millionths.

    A text is cut where it is read; the vectors of a batch's distinct tokens are
    made at once and added up.  A text without tokens keeps the zero vector.
    """

    @F.arrow_udf("array<bigint>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store = _TokenVectors(dims)
        for batch in batches:
            out = []
            for low in range(0, len(batch), EMBED_ROWS):
                part = batch.slice(low, EMBED_ROWS)
                out.append(store.vectors(*cut(part, TOKEN_BYTES), len(part)).ravel())
            flat = np.concatenate([np.zeros(0, np.int64), *out])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dims), pa.array(flat))

    # Marked so that the planner neither repeats it nor moves it below a shuffle.
    return df.withColumn(out_col, embed.asNondeterministic()(F.col(text_col)))


# --- VEC4: what is embedded ---------------------------------------------------


def chunk_input() -> Column:
    """Corpus row to embedding text; blank parts are left out."""
    return F.concat_ws(
        "\n",
        blank_to_null(F.coalesce("note_title", "heading")),
        blank_to_null(F.coalesce("note_summary", "chunk_summary")),
        blank_to_null(F.col("heading")),
        blank_to_null(F.col("source_path")),
        blank_to_null(F.array_join("keywords", " ")),
        blank_to_null(F.array_join("tags", " ")),
        blank_to_null(F.col("text")),
    )


def query_input() -> Column:
    return F.concat_ws(
        "\n",
        blank_to_null(F.col("query")),
        blank_to_null(F.col("intent")),
        blank_to_null(F.array_join("preferred_types", " ")),
        blank_to_null(F.array_join("keywords", " ")),
        blank_to_null(F.array_join("variants", " ")),
    )


def embed_chunks(corpus: DataFrame) -> DataFrame:
    return hash_embed(corpus.withColumn("input", chunk_input()), "input").drop("input")


def embed_queries(plans: DataFrame) -> DataFrame:
    return hash_embed(plans.withColumn("input", query_input()), "input", "query_vector").drop("input")


# --- VEC3: similarity search --------------------------------------------------


def _signed(rows: DataFrame) -> DataFrame:
    """Add ``dims`` and ``sig``: the signs of a vector's products with fixed random directions."""

    @F.pandas_udf("int")
    def sig(values: pd.Series) -> pd.Series:
        out = pd.Series(0, index=values.index)
        for dims, at in values.groupby(values.map(len)).groups.items():
            if dims:
                directions = np.random.default_rng(int(dims)).standard_normal((int(dims), SIGNS))
                signs = np.stack(values.loc[at].to_numpy()).astype(np.float64) @ directions > 0
                out.loc[at] = signs @ (1 << np.arange(SIGNS)[::-1])
        return out

    # Only the vectors pass through Python; names and titles can be as long as texts.
    return rows.filter(F.size("values") > 0).withColumn("dims", F.size("values")).withColumn("sig", sig.asNondeterministic()("values"))


def _lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pack rows of one length and signature prefix into lists of at most ``LIST_ROWS``, each with its center and radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = count(TaskContext.get().partitionId() << 32)

        def flush(held: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(held["values"].to_numpy()).astype(np.int64)
            center = x.mean(axis=0)
            radius = float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))
            return pd.DataFrame({"list": [next(names)], "dims": [x.shape[1]], "center": [center.tobytes()], "radius": [radius * (1 + 1e-9) + 1.0],
                                 "data": [x.tobytes()], **{c: [held[c].tolist()] for c in columns}})

        parts, key, n = [], None, 0
        for pdf in batches:
            for (dims, near), part in pdf.groupby(["dims", "near"], sort=False):
                for low in range(0, len(part), LIST_ROWS):
                    piece = part.iloc[low : low + LIST_ROWS]
                    if parts and (key != (dims, near) or n + len(piece) > LIST_ROWS):
                        yield flush(pd.concat(parts))
                        parts, n = [], 0
                    parts.append(piece)
                    key, n = (dims, near), n + len(piece)
        if parts:
            yield flush(pd.concat(parts))

    kinds = dict(rows.dtypes)
    arrays = ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns)
    return rows.mapInPandas(run, f"list long, dims int, center binary, radius double, data binary, {arrays}")


def _query_blocks(queries: DataFrame, block: int) -> DataFrame:
    """Queries packed by vector length: ``block, dims, query_id, banned, data``."""
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = count(TaskContext.get().partitionId() << 32)
        for pdf in batches:
            for dims, part in pdf.groupby(pdf["query_vector"].map(len)):
                for low in range(0, len(part), block):
                    q = part.iloc[low : low + block]
                    yield pd.DataFrame({"block": [next(names)], "dims": [dims], "query_id": [q["query_id"].tolist()], "banned": [[list(s) for s in q["excluded_statuses"]]], "scope": [[None if pd.isna(x) else x for x in q["scope"]]],
                                        "data": [np.stack(q["query_vector"].to_numpy()).astype(np.int64).tobytes()]})

    scope = F.col("scope_repo") if "scope_repo" in queries.columns else F.lit(None).cast("string")
    rows = queries.filter(F.size("query_vector") > 0).select("query_id", "query_vector", "excluded_statuses", scope.alias("scope"))
    return rows.mapInPandas(run, f"block long, dims int, query_id array<{kind}>, banned array<array<string>>, scope array<string>, data binary")


def _reached(lists: DataFrame, asked: DataFrame, need: int) -> DataFrame:
    """``(block, list)`` pairs in which some query can reach ``need``: its product with the center plus its length times the radius.

    Heads of lists meet query blocks as keyed rows, numbers only.
    """
    n_lists, n_asked = lists.count(), asked.count()
    groups, sides = -(-n_lists // HEADS) or 1, -(-n_asked // 8) or 1

    def bound(queries: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"block": [], "list": []}, dtype="int64")]
        for dims, of in heads.groupby("dims"):
            centers = np.frombuffer(b"".join(of["center"]), np.float64).reshape(len(of), dims)
            for q in queries[queries["dims"] == dims].itertuples(index=False):
                x = np.frombuffer(q.data, np.int64).reshape(-1, dims).astype(np.float64)
                most = x @ centers.T + np.sqrt((x**2).sum(axis=1))[:, None] * of["radius"].to_numpy()
                out.append(pd.DataFrame({"block": q.block, "list": of["list"].to_numpy()[(most + 1e6 >= need * 1e6 - 500_000).any(axis=0)]}))
        return pd.concat(out, ignore_index=True)

    left = asked.select("block", "dims", "data", F.pmod(F.xxhash64("block"), F.lit(sides)).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = lists.select("list", "dims", "center", "radius", F.pmod(F.xxhash64("list"), F.lit(groups)).cast("int").alias("part"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))).alias("side"))
    return left.groupBy("side", "part").cogroup(right.groupBy("side", "part")).applyInPandas(bound, "block long, list long")


def similarity_top(
    vectors: DataFrame, queries: DataFrame, *, id_col: str, pool: int,
    keys: list[str], min_similarity: float = P.MIN_SIMILARITY, block: int = QUERY_BLOCK,
) -> DataFrame:
    """JON7: best rows per query by cosine, at or above the threshold.

    ``vectors`` has ``id_col``, ``values`` (whole millionths), ``status`` and
    the tie-break columns ``keys``; ``queries`` has ``query_id``,
    ``query_vector`` and ``excluded_statuses``.  Vectors of another length than
    the query's never match.  Queries with a ``scope_repo`` match vectors of that
    ``repo_slug`` only.  Similarity is rounded to six places.
    """
    need = int(round(min_similarity * 1e6))
    scoped = "scope_repo" in queries.columns
    rule = ["status", *(["repo_slug"] if scoped else [])]
    named = list(dict.fromkeys([id_col, *keys, *rule]))
    query_kind = dict(queries.dtypes)["query_id"]
    rows = materialise(_signed(vectors.select(*named, "values")).withColumn("row", F.monotonically_increasing_id()))
    bits = min(SIGNS, max(0, (rows.count() // LIST_ROWS).bit_length()))
    order = ["dims", "near", *keys]
    near = rows.withColumn("near", F.shiftright("sig", SIGNS - bits))
    near = near.repartitionByRange(*order).sortWithinPartitions(*order).select("row", *rule, "values", "dims", "near")
    lists = materialise(_lists(near, ["row", *rule]))
    asked = materialise(_query_blocks(queries, block))
    pairs = _reached(lists, asked, need).join(asked.withColumnRenamed("data", "matrix").drop("dims").withColumnRenamed("query_id", "query_ids"), "block")

    def score(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out, asked_by = [], []
        for r in found.itertuples(index=False):
            x = np.frombuffer(r.data, np.int64).reshape(-1, r.dims).astype(np.float64)
            status = np.array(r.status, dtype=object)
            row = np.array(r.row, np.int64)
            for q in blocks.itertuples(index=False):
                # Every product and partial sum is a whole number below 2**53.
                dots = np.frombuffer(q.matrix, np.int64).reshape(-1, r.dims).astype(np.float64) @ x.T
                micro = np.floor((np.abs(dots) + 500_000) / 1e6) * np.sign(dots)
                for s in {s for banned in q.banned for s in banned}:
                    micro[np.ix_(np.array([s in banned for banned in q.banned]), status == s)] = -np.inf
                for repo in {x for x in q.scope if x is not None} if scoped else ():
                    micro[np.ix_(np.array([x == repo for x in q.scope]), np.array(r.repo_slug, dtype=object) != repo)] = -np.inf
                for i, query in enumerate(q.query_ids):
                    good = np.flatnonzero(micro[i] >= need)
                    # Rows are in tie order, so that a stable sort keeps the right ones.
                    best = good[np.argsort(-micro[i][good], kind="stable")[:pool]]
                    asked_by += [query] * len(best)
                    out.append((micro[i][best] / 1e6, row[best]))
        # Objects: texts of frames put together come as several pieces, which Arrow refuses as one column.
        return pd.DataFrame({"query_id": pd.Series(asked_by, dtype=object), **{
            c: np.concatenate([np.zeros(0, kind), *[x[k] for x in out]]) for k, (c, kind) in enumerate((("similarity", np.float64), ("row", np.int64)))}})

    found = pairs.groupBy("list").cogroup(lists.groupBy("list")).applyInPandas(score, f"query_id {query_kind}, similarity double, row long")
    # Names come to the pool and its ties only.
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("similarity")))
    best = materialise(found.withColumn("at", place).filter(F.col("at") <= pool).drop("at"))
    tie = [k for k in keys if k != id_col]
    found = rows.select("row", id_col, *tie).join(small(best), "row").select("query_id", id_col, "similarity", *tie)
    return top_pool(found, pool, F.desc("similarity"), *keys)


def vector_search(
    plans: DataFrame, corpus: DataFrame, *, pool: int, repo_slug: str | None = None,
    note_type: str | None = None, integrity_mode: str = "prefer-healthy",
) -> DataFrame:
    """VEC3 over a corpus with a ``values`` column."""
    docs = filter_corpus(corpus, repo_slug, note_type, integrity_mode)
    queries = embed_queries(plans.filter(F.col("needle") != ""))
    return similarity_top(
        docs, queries, id_col="chunk_id", pool=pool, keys=["source_file", "heading", "chunk_id"]
    )
