"""Exact near-duplicate vectors by a metric range join with pivots.

Cosine similarity of at least c is a distance of at most ``r = sqrt(2 - 2 c)`` between unit vectors. Every vector's
home is the cell of its nearest pivot. By the triangle inequality, a vector within ``r`` of one at home in cell j is at
most ``2 r`` farther from pivot j than from its own pivot i; more sharply, it is within ``r`` of the plane midway between
the two pivots, so ``d_j^2 - d_i^2 <= 2 r |p_i - p_j|``. Vectors are replicated to the cells that this leaves, and
each cell counts the links of its own vectors independently. Cells of one label only hold that label. Cells of many
vectors are cut into chunks, and every pair of a chunk of home vectors with a chunk of the cell is a task of its own,
so that a task's memory is bounded whatever the cell holds.

Pivots are shared by all labels: one for every ``cell_rows`` distinct vectors of the largest label, chosen farthest
first from a bounded sample. A label of fewer vectors is one cell. Where the data have no clusters, as random vectors of many
dimensions, most vectors lie near some plane, and cells save little; links are exact at any rate.

Equal vectors of a label are one vector with a multiplicity from the start, so copies are never compared. A cell gives
the number of links of every vector and a spanning forest of its links, never all pairs.

Nulls and odd rows: vectors that are null, empty, zero, of another length than their partner, or that hold null or
non-finite components, and vectors with a null label or id, link with nothing: 0 links, a component of their own; repeated rows are
copies that link with each other; a cosine equal to the limit links, as settled by exact sums; vectors may have any number
of components; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, forest, materialize, release
from tidemark.session import ship

#: At most this many pivots are taken, out of so many vectors of the smallest hashes: those are on the driver.
MAX_PIVOTS, MAX_SAMPLE = 256, 2048
#: Distances and cosines nearer to a limit than this are settled anew, or replicated.
SLACK = 1e-9


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def near(home: np.ndarray, other: np.ndarray, home_raw: np.ndarray, other_raw: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (home, other) with cosine of at least ``cosine``; those within rounding of it by exact sums."""
    c = home @ other.T
    i, j = np.nonzero(c >= cosine - SLACK)
    edge = np.flatnonzero(c[i, j] < cosine + SLACK)
    keep = np.ones(len(i), bool)
    for k in edge:
        keep[k] = exact_cosine(home_raw[i[k]], other_raw[j[k]]) >= cosine
    return i[keep], j[keep]


def farthest_first(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of ``sample``: the first, and then always the one farthest from all chosen, while there are unlike ones."""
    chosen, apart = [0], np.full(len(sample), np.inf)
    while len(chosen) < wanted:
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        far = int(apart.argmax())
        if apart[far] <= SLACK:
            break
        chosen.append(far)
    return sample[chosen]


def cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it's the row's home) of unit vectors: the nearest pivot's cell, and those whose middle plane
    is within ``reach``."""
    far = np.maximum(0.0, 2 - 2 * x @ pivots.T)
    own = far.argmin(axis=1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    who, cell = np.nonzero(far - far.min(axis=1, keepdims=True) <= 2 * (reach * gap[own] + SLACK))
    return who, cell.astype(np.int32), own[who] == cell


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, cell_rows: int = 4096, chunk: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    ship(spark)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("e"), F.col(label_col).alias("label"))
    norm2 = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite, F.lit(False))
    v = v.withColumn("fine", fine)
    v = v.withColumn("fine", F.when(F.col("fine"), (norm2 > 0) & (norm2 < float("inf"))).otherwise(False))
    classes, _ = materialize(v.where("fine").groupBy("label", "e").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    wanted = max(1, min(MAX_PIVOTS, -(-largest // cell_rows)))
    sample: dict[int, list] = {}
    if wanted > 1:
        for r in classes.orderBy(F.xxhash64("e"), "rep").select("e").limit(min(MAX_SAMPLE, 16 * wanted)).collect():
            sample.setdefault(len(r[0]), []).append(r[0])
    pivots = {d: farthest_first(unit(rows), wanted) for d, rows in sample.items()}

    def place(frames):
        for pdf in frames:
            out = []
            for d, rows in pdf.groupby(pdf["e"].map(len)).groups.items():
                part = pdf.loc[rows]
                if d not in pivots:
                    out.append(part.assign(cell=0, home=True))
                    continue
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    who, cell, home = cells(unit(some["e"].tolist()), pivots[d], reach)
                    out.append(some.iloc[who].assign(cell=cell, home=home))
            if out:
                yield pd.concat(out)

    schema = f"label {dict(classes.dtypes)['label']}, e array<double>, rep bigint, copies bigint, cell int, home boolean"
    placed, p1 = materialize(classes.mapInPandas(place, schema), "cells")
    key = ["label", "cell", "d"]
    placed = placed.withColumn("d", F.size("e"))
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    placed = placed.join(sizes, key)
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    homes = placed.where("home").withColumns({"mine": F.col("salt"), "their": each})
    others = placed.withColumns({"mine": each, "their": F.col("salt"), "home": F.lit(False)})
    dealt = homes.unionByName(others).select(*key, "mine", "their", "home", "rep", "copies", "e")

    def count_links(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, all_ = pdf[pdf["home"]], pdf[~pdf["home"]]
        ids, copies = mine["rep"].to_numpy(np.int64), mine["copies"].to_numpy(np.int64)
        links, trees = np.zeros(len(mine), np.int64), []
        if len(mine):
            raw, home = np.array(mine["e"].tolist(), np.float64), unit(mine["e"].tolist())
            for at in range(0, len(all_), 512):
                block = all_.iloc[at : at + 512]
                their, many = block["rep"].to_numpy(np.int64), block["copies"].to_numpy(np.int64)
                i, j = near(home, unit(block["e"].tolist()), raw, np.array(block["e"].tolist(), np.float64), cosine)
                other = ids[i] != their[j]
                i, j = i[other], j[other]
                np.add.at(links, i, many[j])
                if len(i):
                    trees.append(forest(ids[i], their[j]))
        a = np.concatenate([ids, *(t[0] for t in trees)])
        b = np.concatenate([ids, *(t[1] for t in trees)])
        n = np.concatenate([links, np.full(len(a) - len(ids), -1)])
        return pd.DataFrame({"a": a, "b": b, "n": n})

    found, p2 = materialize(dealt.groupBy(*key, "mine", "their").applyInPandas(count_links, "a bigint, b bigint, n bigint"), "links")
    members, _ = connected_components(found.where("n < 0"))
    per, _ = materialize(found.where("n >= 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links")), "counts")
    release(spark, p1, p2)
    per = per.join(members.withColumnRenamed("node", "rep"), "rep", "left")
    reps = classes.join(per, "rep", "left").select("label", "e", "rep", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    good = v.where("fine").join(reps, ["label", "e"]).select("id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    rest = v.where("NOT fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
