"""Tables kept by key, whose upserts cost what they change.

A table is a set of parts by leading bits of the key's hash, each a folder of Parquet files, and a few changes: folders with
the rows of later upserts. An upsert writes its rows as a change. A part takes in the rows that wait for it once they are a
quarter of its own (and ``LEAST``), by itself, and is cut by further bits of the hash when it has outgrown ``LIMIT`` rows; a cut
touches no other part. Changes that wait are put together when the newer ones are as large as the one before them, so that
they stay few (logarithm of the waiting rows). A row is rewritten a bounded number of times for each doubling of the table.

Readers put the changes in place of rows with the same key: the changes are small, so that the parts are not shuffled where
Spark can broadcast them.

The state is a small JSON file for each version, renamed into place last: folders of a job that failed are in none and are
written anew. It names each part with its rows. Files go when no state of the last ``KEEP`` names them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of a part before it is cut; waiting rows before a part takes them in: this share of it and this number.
LIMIT, SHARE, LEAST = 1_000_000, 4, 20_000
#: States kept for readers of older ones.
KEEP = 3


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def states(spark: SparkSession, root: str) -> list[int]:
    fs, p = _path(spark, f"{root}/state=*.json")
    return sorted(int(s.getPath().getName()[6:-5]) for s in fs.globStatus(p) or [])


def state(spark: SparkSession, root: str, n: int) -> dict:
    fs, p = _path(spark, f"{root}/state={n}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, root: str) -> dict | None:
    have = states(spark, root)
    return state(spark, root, have[-1]) if have else None


def _write_state(spark: SparkSession, root: str, m: dict) -> None:
    fs, temp = _path(spark, f"{root}/.state={m['n']}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(m).encode()))
    out.close()
    if not fs.rename(temp, _path(spark, f"{root}/state={m['n']}.json")[1]):
        raise RuntimeError(f"another writer has made version {m['n']} of {root}")


def bits(keys: Sequence[str], depth: int | Column) -> Column:
    """Leading bits of the key's hash, as text."""
    return F.substring(F.lpad(F.bin(F.xxhash64(*keys)), 64, "0"), F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def _depth(m: dict) -> int:
    return max(len(b) for b in m["parts"])


def _buckets(part: str, depth: int) -> list[str]:
    """All prefixes of ``depth`` bits that a part holds."""
    free = depth - len(part)
    return [part + (f"{i:0{free}b}" if free else "") for i in range(1 << free)]


def _part_of(bucket: str, parts: dict) -> str:
    return next(bucket[:k] for k in range(len(bucket) + 1) if bucket[:k] in parts)


def changes(spark: SparkSession, root: str, m: dict, of: Sequence[dict], only: set[str] | None = None) -> DataFrame:
    """The last row of each key among the changes ``of``, for the parts that still wait for it."""
    keys, depth = m["keys"], _depth(m)
    waits = [(c["n"], b) for c in of for part in c["waits"] if only is None or part in only for b in _buckets(part, depth)]
    frames = [spark.read.parquet(f"{root}/{c['path']}").withColumn("_n", F.lit(c["n"]).cast("int")) for c in of]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    names = spark.createDataFrame(waits, "_n int, _bucket string")
    rows = rows.withColumn("_bucket", bits(keys, depth)).join(names, ["_n", "_bucket"], "left_semi")
    last = Window.partitionBy(*keys).orderBy(F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_n", "_bucket")


def _put(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base with ``rows`` in place of those with the same key, null keys included."""
    named = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return base.join(named, same, "left_anti").unionByName(rows)


def _base(spark: SparkSession, root: str, m: dict, parts: Sequence[str]) -> DataFrame | None:
    paths = [f"{root}/{m['parts'][p]['path']}" for p in parts if m["parts"][p]["path"]]
    return spark.read.parquet(*paths) if paths else None


def read(spark: SparkSession, root: str, m: dict) -> DataFrame:
    base = _base(spark, root, m, list(m["parts"]))
    if not m["changes"]:
        return base
    rows = changes(spark, root, m, m["changes"])
    return rows if base is None else _put(base, rows, m["keys"])


def lookup(spark: SparkSession, root: str, m: dict, wanted: DataFrame) -> DataFrame:
    """The table's rows with a key of ``wanted`` (unique keys); only the parts that can hold them are read."""
    keys, depth = m["keys"], _depth(m)
    found = {_part_of(r[0], m["parts"]) for r in wanted.select(bits(keys, depth)).distinct().collect()}
    base = _base(spark, root, m, sorted(found))
    waiting = [c for c in m["changes"] if found & set(c["waits"])]
    if waiting:
        rows = changes(spark, root, m, waiting, found)
        base = rows if base is None else _put(base, rows, keys)
    if base is None:
        return read(spark, root, m).limit(0)
    named = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return base.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")


def _taken_in(spark: SparkSession, root: str, m: dict, parts: dict[str, int], n: int) -> dict[str, dict]:
    """The given parts (with their waiting rows) written with all changes that wait for them: the parts that take their place."""
    keys, depth = m["keys"], _depth(m)
    sizes = {p: m["parts"][p]["rows"] + waiting for p, waiting in parts.items()}
    deeper = {p: len(p) + max(0, (-(-size // LIMIT) - 1).bit_length()) for p, size in sizes.items()}
    base, rows = _base(spark, root, m, list(parts)), changes(spark, root, m, m["changes"], set(parts))
    whole = rows if base is None else _put(base, rows, keys)
    names = spark.createDataFrame([(b, deeper[p]) for p in parts for b in _buckets(p, depth)], "_bucket string, _deep int")
    dealt = whole.withColumn("_bucket", bits(keys, depth)).join(names, "_bucket").withColumn("_part", F.concat(F.lit("p"), bits(keys, F.col("_deep"))))
    dealt = dealt.drop("_bucket", "_deep").repartition("_part")
    dealt.write.mode("overwrite").partitionBy("_part").parquet(f"{root}/base={n}")
    found = spark.read.parquet(f"{root}/base={n}").groupBy("_part").count().collect()
    count = {r["_part"][1:]: r["count"] for r in found}
    new = [b for p in parts for b in _buckets(p, deeper[p])]
    return {b: {"path": f"base={n}/_part=p{b}" if b in count else None, "rows": count.get(b, 0)} for b in new}


def upsert(df: DataFrame, root: str, keys: Sequence[str], whole: int = 0, batch: tuple[str, int] | None = None) -> int:
    """Put the rows of ``df`` in place by key; ``whole`` is the number of a version ``v=`` that holds a table written whole.

    Returns the number of the state that holds them: the last one if there is nothing to do.
    """
    spark = df.sparkSession
    m = newest(spark, root)
    if m is None or m["n"] < whole:
        first = {"path": f"v={whole}", "rows": spark.read.parquet(f"{root}/v={whole}").count()} if whole else {"path": None, "rows": 0}
        m = {"n": whole, "keys": list(keys), "parts": {"": first}, "changes": [], "seen": {}}
    if batch and m["seen"].get(batch[0], -1) >= batch[1]:
        return m["n"]
    if m["keys"] != list(keys):
        raise ValueError(f"the table is kept by {m['keys']}")
    n, depth = m["n"] + 1, _depth(m)
    df.write.mode("overwrite").parquet(f"{root}/change={n}")
    counted = spark.read.parquet(f"{root}/change={n}").groupBy(bits(keys, depth).alias("b")).count().collect()
    if not counted:
        _delete(spark, f"{root}/change={n}")
        return m["n"]
    waits: dict[str, int] = {}
    for r in counted:
        part = _part_of(r["b"], m["parts"])
        waits[part] = waits.get(part, 0) + r["count"]
    m["changes"].append({"n": n, "path": f"change={n}", "waits": waits})
    waiting: dict[str, int] = {}
    for c in m["changes"]:
        for p, k in c["waits"].items():
            waiting[p] = waiting.get(p, 0) + k
    ripe = {p: k for p, k in waiting.items() if k >= max(LEAST, m["parts"][p]["rows"] / SHARE)}
    if ripe:
        new = _taken_in(spark, root, m, ripe, n)
        m["parts"] = {p: x for p, x in m["parts"].items() if p not in ripe} | new
        for c in m["changes"]:
            c["waits"] = {p: k for p, k in c["waits"].items() if p not in ripe}
        m["changes"] = [c for c in m["changes"] if c["waits"]]
    _put_together(spark, root, m, n)
    m["n"] = n
    if batch:
        m["seen"][batch[0]] = batch[1]
    _write_state(spark, root, m)
    _retire(spark, root)
    return n


def _put_together(spark: SparkSession, root: str, m: dict, n: int) -> None:
    """The newest changes as one, as long as the one before them is no larger."""
    sizes = [sum(c["waits"].values()) for c in m["changes"]]
    k, size = len(sizes) - 1, sum(sizes[-1:])
    while k > 0 and sizes[k - 1] <= size:
        k -= 1
        size += sizes[k]
    if k >= len(sizes) - 1:
        return
    some = m["changes"][k:]
    changes(spark, root, m, some).write.mode("overwrite").parquet(f"{root}/changes={n}")
    waits: dict[str, int] = {}
    for c in some:
        for p, x in c["waits"].items():
            waits[p] = waits.get(p, 0) + x
    m["changes"][k:] = [{"n": n, "path": f"changes={n}", "waits": waits}]


def _named(m: dict) -> set[str]:
    return {p["path"] for p in m["parts"].values() if p["path"]} | {c["path"] for c in m["changes"]} | {f"change={m['n']}", f"changes={m['n']}"}


def _retire(spark: SparkSession, root: str) -> None:
    """Remove states but the last few, and what only they name."""
    have = states(spark, root)
    kept = set().union(*[_named(state(spark, root, n)) for n in have[-KEEP:]])
    for n in have[:-KEEP]:
        for path in _named(state(spark, root, n)) - kept:
            if not path.startswith("v="):  # whole versions have their own order of removal
                _delete(spark, f"{root}/{path}")
        _delete(spark, f"{root}/state={n}.json")
