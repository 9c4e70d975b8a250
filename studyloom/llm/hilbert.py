"""Shards along a Hilbert curve through metadata: rows that are near in every dimension share a shard, so that files can be passed over.

Each dimension is quantised to 2^BITS cells that hold about equally many rows: a value's cell is where its first row stands in the order
of the dimension. The cells' curve index orders the rows, and runs of that order are cut into shards. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, placed, sent_to_all, settle

#: Cells of a dimension, as a power of two; shards of the query; copies of a dimension's value that hot values are spread over.
BITS, SHARDS, SALTS = 8, 24, 16
DIMENSIONS = ("lang", "source", "scale")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null) and eight."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def scale(size: Column) -> Column:
    """A size on a scale of eight steps to a doubling, by integer arithmetic only."""
    power = F.length(F.bin(size)) - 1
    return (power * 8 + F.call_function("shiftright", size * 8, power) % 8).cast("long")


def ordered(value: Column, kind: str) -> Column:
    """A string that sorts as the value does, which is a string or a number from 0 on."""
    return value if kind == "string" else F.lpad(value.cast("string"), 20, "0")


def curve_index(cells: list[Column], bits: int) -> Column:
    """The Hilbert index of a point of n cells of so many bits: rotate and reflect from the highest bit down, Gray-code, interleave."""
    n = len(cells)

    def axis(k: int, bit: Column):
        """Swaps the bits below this one between axes 0 and k where they differ and axis k has it not; where it has, reflects axis 0."""
        low, none = bit - 1, F.lit(0).cast("long")

        def at(p: Column) -> Column:
            if k == 0:
                return F.array(p[0].bitwiseXOR(F.when(p[0].bitwiseAND(bit) != 0, low).otherwise(none)), *[p[j] for j in range(1, n)])
            swap = F.when(p[k].bitwiseAND(bit) == 0, p[0].bitwiseXOR(p[k]).bitwiseAND(low))
            return F.array(p[0].bitwiseXOR(F.coalesce(swap, low)), *[p[j].bitwiseXOR(F.coalesce(swap, none)) if j == k else p[j] for j in range(1, n)])

        return at

    def turned(point: Column, bit: Column) -> Column:
        for k in range(n):
            point = let(point, axis(k, bit))
        return point

    def gray(point: Column) -> Column:
        out = [point[0]]
        for k in range(1, n):
            out.append(out[-1].bitwiseXOR(point[k]))
        return F.array(*out)

    def undone(point: Column) -> Column:
        last = point[n - 1]
        masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
        flips = F.aggregate(masks, F.lit(0).cast("long"), lambda t, bit: F.when(last.bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t))
        return let(flips, lambda t: F.transform(point, lambda v: v.bitwiseXOR(t)))

    def woven(point: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits):
            for k in range(n):
                out = out.bitwiseOR(F.shiftleft(F.shiftright(point[k], b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - k))
        return out

    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    point = F.aggregate(masks, F.array(*[c.cast("long") for c in cells]), turned)
    return let(let(let(point, gray), undone), woven)


def with_cells(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Adds cell_<d>, from 0 to 2^bits - 1, for each dimension: where the value's first row stands among all rows, null before all.

    All dimensions' values are counted in one pass and ranked by their counts' running sum, so nothing grows with a value's rows. They
    meet the rows by broadcast or, if there are too many values for that, in salted copies, as one value may have most rows.
    """
    value = {d: ordered(F.col(d), dict(rows.dtypes)[d]) for d in dimensions}
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("grp"), v.alias("value")) for d, v in value.items()])).alias("v")).select("v.*")
    counted = placed(settle(each.groupBy("grp", "value").agg(F.count("*").alias("rows"))), "grp", ["value"], "rows")
    known = settle(counted.select("grp", "value", F.floor(F.col("before") * (1 << bits) / F.col("total")).cast("long").alias("cell")))
    small = sent_to_all(known)
    for d in dimensions:
        if small is known:
            mine = known.where(F.col("grp") == d).select(F.col("value").alias("__value"), F.col("cell").alias(f"cell_{d}"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
            spread = rows.withColumn("__own", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int"))
            rows = spread.join(mine, (F.col("__own") == F.col("__salt")) & value[d].eqNullSafe(F.col("__value"))).drop("__own", "__salt", "__value")
        else:
            mine = small.where(F.col("grp") == d).select(F.col("value").alias("__value"), F.col("cell").alias(f"cell_{d}"))
            rows = rows.join(mine, value[d].eqNullSafe(F.col("__value"))).drop("__value")
    return rows


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, lang, source, scale, curve) of each row of docs(doc_id, text, lang, source).

    The law is `rows`: shards' row counts differ by one at most; with fewer rows than shards some are empty. Rows are ordered by the curve,
    then by checksum, so that equal texts of one kind stand together, then by doc_id, null first; equal rows have slots of their own.
    A null text counts no bytes and has the checksum of the empty one; null lang and source are values of their own. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    size = size_of(F.col("text"))
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), scale(size).alias("scale"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = settle(rows.withColumn("tie", F.monotonically_increasing_id()))
    curve = curve_index([F.col(f"cell_{d}") for d in DIMENSIONS], BITS)
    rows = settle(with_cells(rows).withColumn("curve", curve).withColumn("grp", F.lit(0)))
    rows = placed(rows, "grp", ["curve", "text_crc32", "doc_id", "tie"])
    shard = F.expr(f"i * {count} div n")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("i") - F.expr(f"(i * {count} div n * n + {count - 1}) div {count}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "scale", "curve",
    )


def bounds(sharded: DataFrame) -> DataFrame:
    """What a reader needs to pass over files: each shard's rows, bytes and range of every dimension."""
    ranges = [f(d).alias(f"{name}_{d}") for d in (*DIMENSIONS, "curve") for name, f in (("least", F.min), ("most", F.max))]
    nulls = [F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in ("lang", "source")]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges, *nulls)


def may_hold(limits: DataFrame, **wanted: tuple) -> DataFrame:
    """The shards of bounds() that can hold a row with each dimension in its (least, most); the others need not be opened."""
    out = limits
    for d, (least, most) in wanted.items():
        out = out.where((F.col(f"most_{d}") >= least) & (F.col(f"least_{d}") <= most))
    return out


def write(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Writes docs, joined with their shard by a doc_id that is unique, as one folder a shard, each file a run of slots."""
    where = sharded.select("doc_id", "shard", "slot", "curve")
    rest = [c for c in docs.columns if c not in ("shard", "slot", "curve")]
    docs.select(*rest).join(where, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _sql() -> str:
    """The same cells, curve and cuts; each step of the curve is a table of its own."""
    n, steps, at = len(DIMENSIONS), [], "x0"
    for b in range(BITS - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for k in range(n):
            swap = f"CASE WHEN a{k} & {bit} = 0 THEN xor(a0, a{k}) & {low} END"
            first = f"xor(a0, CASE WHEN a0 & {bit} <> 0 THEN {low} ELSE 0 END)" if k == 0 else f"xor(a0, coalesce({swap}, {low}))"
            rest = [f"xor(a{j}, coalesce({swap}, 0))" if j == k else f"a{j}" for j in range(1, n)]
            name = f"x{b}_{k}"
            steps.append(f"{name} AS MATERIALIZED (SELECT id, {first} AS a0, {', '.join(f'{r} AS a{j}' for j, r in enumerate(rest, 1))} FROM {at})")
            at = name
    grays = ", ".join("xor(" * k + "a0" + "".join(f", a{j})" for j in range(1, k + 1)) + f" AS a{k}" for k in range(n))
    flips = "0"
    for b in range(BITS - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN a{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    woven = " + ".join(f"(((xor(a{k}, t) >> {b}) & 1) << {b * n + n - 1 - k})" for b in range(BITS) for k in range(n))
    cells = ", ".join(f"c{k} AS (SELECT {d} AS v, (sum(count(*)) OVER (ORDER BY {d} NULLS FIRST) - count(*)) * {1 << BITS} // sum(count(*)) OVER () AS cell FROM d GROUP BY 1)" for k, d in enumerate(DIMENSIONS))
    joins = " ".join(f"JOIN c{k} ON c{k}.v IS NOT DISTINCT FROM d.{d}" for k, d in enumerate(DIMENSIONS))
    return f"""
WITH b AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(strlen(text), 0) + 8 AS size, coalesce(text, '') AS text FROM documents),
d AS MATERIALIZED (SELECT *, (length(bin(size)) - 1) * 8 + size * 8 // (1::BIGINT << (length(bin(size)) - 1)) % 8 AS scale FROM b),
{cells}, x0 AS MATERIALIZED (SELECT id, {', '.join(f'CAST(c{k}.cell AS BIGINT) AS a{k}' for k in range(n))} FROM d {joins}),
{', '.join(steps)}, g AS (SELECT id, {grays} FROM {at}), f AS (SELECT *, {flips} AS t FROM g), w AS (SELECT id, {woven} AS curve FROM f),
k AS (SELECT hex(encode(text)) AS h, text FROM (SELECT DISTINCT text FROM d)),
z AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda q: ('0x' || substr(h, 2 * q + 1, 2))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) AS crc FROM k),
o AS (SELECT d.*, curve, crc, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM d JOIN w USING (id) JOIN z USING (text))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(i * {SHARDS} // n AS INTEGER) AS shard, i - (i * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, lang, source, scale, curve FROM o
"""


SQL = _sql()
