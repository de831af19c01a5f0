"""Exact and fuzzy deduplication of facility records."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelake.functions.text import positional_match
from placelake.operators.rounds import cut, numbered, running

THRESHOLD = 0.85
# The greatest likeness of records whose streets and names both differ: only above it equal streets or names are necessary.
NEITHER_EQUAL = 0.82
CROWD = 64
"""Records of a phone and street, or phone and name, that are all compared with each other."""
DENSE = 50_000
"""Records of a phone and street, or name, and postal code up to which a crowd is compared tile by tile, in arrays."""
TILE = 4096
# Two fields may be alike at the least match of 0.7 (names) and 0.8 (streets), compared in blocks of two characters.
_BLOCK = 2


def signature(df: DataFrame) -> DataFrame:
    """Normalised phone, address and name with their hashes."""
    get = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = F.filter(F.array(*(F.lower(F.trim(get(c))) for c in ("address", "city", "zip_code"))), lambda x: x != "")
    df = df.withColumn("phone_key", F.regexp_replace(get("phone"), r"\D", "")).withColumn("address_key", F.array_join(parts, "|")).withColumn("name_key", F.regexp_replace(F.lower(F.trim(get("name"))), r"[^\w\s]", ""))
    for c in ("phone", "address", "name"):
        df = df.withColumn(f"{c}_hash", F.substring(F.md5(F.col(f"{c}_key")), 1, 8))
    return df.withColumn("full_hash", F.md5(F.concat_ws("|", "phone_key", "address_key", "name_key")))


def similarity(a: str, b: str) -> Column:
    """Of two records, as structs ``a`` and ``b`` with phone_key, address, name_key and zip_code."""
    x = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))

    def graded(p: Column, q: Column, equal: float, near: float, least: float) -> Column:
        return F.when((p != "") & (p == q), equal).when((p != "") & (q != "") & (positional_match(p, q) >= least), near).otherwise(0.0)

    phone, zips = x("phone_key"), tuple(F.substring(c, 1, 5) for c in x("zip_code"))
    out = F.when((phone[0] != "") & (phone[0] == phone[1]), 0.4).otherwise(0.0)
    out += graded(*(F.lower(c) for c in x("address")), 0.3, 0.21, 0.8) + graded(*x("name_key"), 0.2, 0.1, 0.7)
    return out + F.when((zips[0] != "") & (zips[0] == zips[1]), 0.1).otherwise(0.0)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the least ``order`` for each key: an aggregate, so that copies meet on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(df.columns)


def _match(a: str, b: str) -> float:
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a and b else 0.0


def records_alike(a: tuple, b: tuple, threshold: float = THRESHOLD) -> bool:
    """Whether two records (phone, street, name, zip5, address key) are the same: equal phones and addresses, or likeness of ``threshold``."""
    if a[0] and a[4] and (a[0], a[4]) == (b[0], b[4]):
        return True
    s = 0.4 if a[0] and a[0] == b[0] else 0.0
    s += 0.3 if a[1] and a[1] == b[1] else 0.21 if _match(a[1], b[1]) >= 0.8 else 0.0
    s += 0.2 if a[2] and a[2] == b[2] else 0.1 if _match(a[2], b[2]) >= 0.7 else 0.0
    s += 0.1 if a[3] and a[3] == b[3] else 0.0
    return round(s, 6) >= threshold or (a[0], a[2], a[4]) == (b[0], b[2], b[4])


def _rarest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of ``rows(*by, most, key)`` the ``most`` + 1 rarest keys of each of ``by``, without those that occur once."""
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("count")), "key")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("count", "key"))).where("rank <= most + 1 AND count > 1")


def _blocks(field: Column) -> Column:
    """The pieces of _BLOCK characters of a text that isn't ''."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(field) - 1) / _BLOCK).cast("int")), lambda i: F.substring(field, i * _BLOCK + 1, F.lit(_BLOCK)))


def _near_keys(sides: DataFrame) -> DataFrame:
    """``sides(phone_key, block, r)`` with ``keys``, one of which alike records of a block share, and a row for each ``key``.

    Beside the street or name of their block such records have the other one in common too, or the postal code and all
    but at most three in ten characters of the other, a street two. See ``_keys`` for why the rarest blocks then meet.
    """
    street = F.col("block").startswith("s")
    field = F.when(street, F.col("r.name_key")).otherwise(F.col("r.address"))
    sides = sides.select("phone_key", "block", "r", field.alias("field"))
    place, apart = ["phone_key", "block", "r"], F.when(street, 0.3).otherwise(0.2)
    near = sides.where("r.zip_code <> ''").select(*place, F.floor((F.length("field") + 1) * apart + 1e-9).alias("most"), F.posexplode(_blocks(F.col("field"))).alias("i", "piece"))
    near = near.select(*place, "most", F.xxhash64("phone_key", "block", "r.zip_code", "i", "piece").alias("key"))
    keys = _rarest(near, place).select(*place, "key").unionByName(sides.select(*place, F.xxhash64("phone_key", "block", "field").alias("key")))
    return keys.groupBy(*place).agg(F.collect_set("key").alias("keys")).withColumn("key", F.explode("keys"))


def _pairs(sides: DataFrame, more: list[str]) -> DataFrame:
    """(a, b, block, ...): records of a block, and of equal ``more``, in both orders."""
    on = ["phone_key", "block", *more]
    a, b = (sides.select(*on, F.col("r").alias(c), *([F.col("keys").alias(f"{c}_keys")] if more else [])) for c in "ab")
    return a.join(b, on).drop("phone_key")


def _letters(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, a row each, with ``pad`` after the end, and the lengths."""
    values = texts.to_pylist()
    lengths = np.array([len(t) for t in values], np.int64)
    out = np.full((len(values), int(lengths.max(initial=0))), pad, np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    return out, lengths


def _tile(step: int = 512):
    """(first, others, other): how many records of another tile each one of a tile is near to, copies included, and the first of them."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.rename_columns([c.removeprefix("b_") for c in b.column_names]).sort_by("first")
        least = a.column("least")[0].as_py() if len(a) else 1.0
        (x, x_len), (y, y_len) = _letters(a.column("field").combine_chunks(), 0xFFFFFFFE), _letters(b.column("field").combine_chunks(), 0xFFFFFFFF)
        width = min(x.shape[1], y.shape[1])
        x, y = x[:, :width], np.ascontiguousarray(y[:, :width].T)
        if all(t[t < 0xFFFFFFFE].max(initial=0) < 254 for t in (x, y)):
            x, y = x.astype(np.uint8), y.astype(np.uint8)  # what follows the end stays unlike
        kind = np.uint8 if width < 255 else np.uint32
        need = np.array([0, *(next(s for s in range(n + 2) if s / n >= least) for n in range(1, int(max(x_len.max(initial=0), y_len.max(initial=0))) + 1))], np.uint32)
        ids = pa.chunked_array([*a.column("first").chunks, *b.column("first").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        own, their = ids[: len(a)], ids[len(a) :]
        copies = b.column("copies").to_numpy().astype(np.float64)
        others, other = np.zeros(len(a)), np.full(len(a), -1)
        for i in range(0, len(a), step):
            rows = slice(i, i + step)
            for j in range(0, len(b), step):
                cols = slice(j, j + step)
                same = np.zeros((len(own[rows]), len(their[cols])), kind)
                for p in range(width):
                    same += x[rows, p, None] == y[p, None, cols]
                near = (same >= need[np.maximum(x_len[rows, None], y_len[None, cols])]) & (own[rows, None] != their[None, cols])
                others[rows] += near @ copies[cols]
                found = near.any(axis=1) & (other[rows] < 0)
                other[rows][found] = near[found].argmax(axis=1) + j
        hit = np.flatnonzero(other >= 0)
        return pa.table({"first": a.column("first").take(pa.array(hit)), "others": pa.array(others[hit].astype(np.int64)), "other": b.column("first").take(pa.array(other[hit]))})

    return run


def _near_in_tiles(dense: DataFrame, tile: int) -> DataFrame:
    """(first, others, other) of ``dense(phone_key, block, r, group)``, whose records are all compared with those of their street or name and postal code.

    A group is dealt into tiles, and each pair of its tiles meets in a task of its own, whatever the group's size.
    """
    street = F.col("block").startswith("s")
    field, least = F.when(street, F.col("r.name_key")).otherwise(F.col("r.address")), F.when(street, 0.7).otherwise(0.8)
    tiles = F.ceil(F.col("group") / tile).cast("int")
    rows = dense.select("phone_key", "block", F.col("r.zip_code").alias("zip_code"), field.alias("field"), least.alias("least"), F.col("r.copies").alias("copies"), F.col("r.first").alias("first"), tiles.alias("tiles"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("first"), F.col("tiles")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["phone_key", "block", "zip_code"]
    a = rows.select(*keys, F.col("at").alias("i"), F.col("to").alias("j"), "field", "least", "first")
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in keys), F.col("to").alias("b_i"), F.col("at").alias("b_j"), *(F.col(c).alias(f"b_{c}") for c in ("field", "copies", "first")))
    kind = dense.select("r.first").schema["first"].dataType.simpleString()
    return a.groupBy(*keys, "i", "j").cogroup(b.groupBy(*(f"b_{c}" for c in keys), "b_i", "b_j")).applyInArrow(_tile(), f"first {kind}, others long, other {kind}")


def links(df: DataFrame, order: str, threshold: float = THRESHOLD, crowd: int = CROWD, dense: int = DENSE, tile: int = TILE) -> DataFrame:
    """How many other records each one is alike to, and the first of them in the order of a column: order, n_links, first_link.

    ``threshold`` must be over NEITHER_EQUAL: then alike records share the phone and the street or the name, so that they are
    blocked by both, and none of the three is blank. Up to ``crowd`` records of a block are compared with each other. Of larger
    blocks those of one postal code are compared tile by tile in arrays, which takes nanoseconds a pair; where these are more
    than ``dense``, those that share a key of ``_near_keys``. Equal records are folded first; they are alike only if what they share
    reaches the threshold by itself.
    """
    if threshold <= NEITHER_EQUAL:
        raise ValueError(f"records with neither street nor name in common may be alike up to {NEITHER_EQUAL}")
    key = ["phone_key", "address", "name_key", "zip_code"]
    folded = signature(df).select(order, "phone_key", F.lower(F.coalesce("address", F.lit(""))).alias("address"), "name_key", F.substring(F.coalesce("zip_code", F.lit("")), 1, 5).alias("zip_code"))
    one = folded.groupBy(*key).agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    block = F.explode(F.array(F.concat(F.lit("s"), "address"), F.concat(F.lit("n"), "name_key")))
    sides = one.where("phone_key <> '' AND address <> '' AND name_key <> ''").select("phone_key", block.alias("block"), F.struct(*key, "copies", "first").alias("r"))
    sizes = sides.groupBy("phone_key", "block").agg(F.count("*").alias("size"))
    sides = sides.join(sizes, ["phone_key", "block"])
    few, crowds = sides.where(F.col("size") <= crowd), sides.where(F.col("size") > crowd).withColumn("zip", F.col("r.zip_code"))
    crowds = crowds.join(crowds.groupBy("phone_key", "block", "zip").agg(F.count("*").alias("group")), ["phone_key", "block", "zip"])
    tiled = (F.col("group") <= dense) | (F.col("zip") == "")
    many = _near_keys(crowds.where(~tiled).select("phone_key", "block", "r"))
    # records of one phone, street and name and of different postal codes; those of crowds too wide to tile have met in them
    twins = crowds.where(F.col("block").startswith("s")).select("phone_key", "block", F.col("r.name_key").alias("name"), "r", tiled.alias("tiled"))
    a, b = (twins.select("phone_key", "block", "name", F.col("r").alias(c), F.col("tiled").alias(f"{c}_tiled")) for c in "ab")
    twins = a.join(b, ["phone_key", "block", "name"]).where("a_tiled or b_tiled").select("a", "b", "block")
    pairs = _pairs(few, []).unionByName(twins).unionByName(_pairs(many, ["key"]).where(F.col("key") == F.array_min(F.array_intersect("a_keys", "b_keys"))).select("a", "b", "block"))
    # a pair with street and name in common counts in the street's block alone
    apart = (F.col("a.first") != F.col("b.first")) & (F.col("block").startswith("s") | (F.col("a.address") != F.col("b.address")))
    alike = pairs.where(apart & (F.round(similarity("a", "b"), 6) >= threshold))
    found = alike.select(F.col("a.first").alias("first"), F.col("b.copies").alias("others"), F.col("b.first").alias("other"))
    if round(0.4 + 0.3 + 0.1 + 0.1, 6) >= threshold:  # what records of a street and postal code with near names reach; with near streets, 0.01 more
        found = found.unionByName(_near_in_tiles(crowds.where(tiled & (F.col("zip") != "")), tile))
    elif round(0.4 + 0.2 + 0.21 + 0.1, 6) >= threshold:
        found = found.unionByName(_near_in_tiles(crowds.where(tiled & (F.col("zip") != "") & F.col("block").startswith("n")), tile))
    found = found.groupBy("first").agg(F.sum("others").alias("others"), F.min("other").alias("other"))
    own = one.withColumn("a", F.struct(*key)).withColumn("own", F.round(similarity("a", "a"), 6) >= threshold)
    second = folded.join(one.where("copies > 1").select(*key, "first"), key).where(F.col(order) > F.col("first")).groupBy(*key).agg(F.min(order).alias("second"))
    each = folded.join(own.select(*key, "copies", "own", "first"), key).join(second, key, "left").join(found, "first", "left")
    copies = F.when(F.col("own"), F.col("copies") - 1).otherwise(0)
    twin = F.when(F.col("own") & (F.col("copies") > 1), F.when(F.col(order) == F.col("first"), F.col("second")).otherwise(F.col("first")))
    return each.select(order, (F.coalesce("others", F.lit(0)) + copies).alias("n_links"), F.least("other", twin).alias("first_link"))


KEY = ("phone_key", "street", "name_key", "zip5", "address_key")
SMALL = 5000
"""Records left undecided, over all phones, that are scanned one after the other in the end."""


def _prepared(df: DataFrame, order: str) -> DataFrame:
    """``df`` with the fields that are compared and its position ``n`` in the order; equal places are parted by the fields."""
    marked = signature(df).withColumn("street", F.lower(F.coalesce("address", F.lit("")))).withColumn("zip5", F.substring(F.coalesce("zip_code", F.lit("")), 1, 5))
    return numbered(marked, order, *KEY, name="n")


def _record() -> Column:
    return F.struct("phone_key", F.col("street").alias("address"), "name_key", F.col("zip5").alias("zip_code"), "address_key")


def _exact(a: str, b: str) -> Column:
    same = lambda *c: F.expr(" and ".join(f"{a}.{x} = {b}.{x}" for x in c))
    return same("phone_key", "address_key") & ((F.expr(f"{a}.phone_key <> '' and {a}.address_key <> ''")) | same("name_key"))


def _keys(records: DataFrame) -> DataFrame:
    """(n, key) such that alike records share a key: what must be equal, and the rarest blocks of what may differ.

    Of a field with at most k places that differ, at most k blocks do; the k + 1 rarest of one record's blocks then have one of
    the other's. Keys are hashes and only block: what they bring together is compared in full.
    """
    phone = F.col("phone_key") != ""
    both = lambda *c: phone & F.expr(" and ".join(f"{x} <> ''" for x in c))
    whole = F.array_compact(F.array(
        F.xxhash64(F.lit("f"), "phone_key", "address_key", "name_key"),
        F.when(both("address_key"), F.xxhash64(F.lit("a"), "phone_key", "address_key")),
        F.when(both("street", "name_key"), F.xxhash64(F.lit("e"), "phone_key", "street", "name_key")),
    ))
    out = records.select("n", F.explode(whole).alias("key"))
    for equal, field, apart in (("street", "name_key", 0.3), ("name_key", "street", 0.2)):
        rows = records.where(both(equal, field, "zip5")).select("n", F.floor((F.length(field) + 1) * F.lit(apart) + 1e-9).alias("most"), equal, "phone_key", "zip5", F.posexplode(_blocks(F.col(field))).alias("i", "block"))
        rows = rows.select("n", "most", F.xxhash64(F.lit(field), "phone_key", equal, "zip5", "i", "block").alias("key"))
        out = out.unionByName(_rarest(rows, ["n"]).select("n", "key"))
    return out


def _scan(threshold: float):
    """The sequential scan of a block: (n, dup) of each of its records."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        seen: set = set()
        near: dict = defaultdict(list)
        out = []
        for r in pdf.sort_values("n").itertuples(index=False):
            dup = bool(r.phone_key and r.address_key and (r.phone_key, r.address_key) in seen)
            now = (r.phone_key, r.street, r.name_key, r.zip5, r.address_key)
            full = (r.phone_key, r.address_key, r.name_key)
            fields = [key for key in (("street", r.street), ("name", r.name_key)) if key[1]]  # one of which must be equal over NEITHER_EQUAL
            some = (k for key in fields for k in near[key]) if threshold > NEITHER_EQUAL else kept
            dup = dup or full in seen or any(records_alike(now, k, threshold) for k in some)
            if not dup:
                kept.append(now)
                for key in fields:
                    near[key].append(now)
                seen |= {(r.phone_key, r.address_key), full}
            out.append((r.n, dup))
        return pd.DataFrame(out, columns=["n", "dup"])

    return scan


def _scanned(records: DataFrame, threshold: float) -> DataFrame:
    """(n, dup) by the sequential scan, blocked by phone, or by all that must be equal where there is none."""
    block = F.when(F.col("phone_key") != "", F.col("phone_key")).otherwise(F.concat_ws("|", "address_key", "name_key"))
    return records.select("n", *KEY, block.alias("block")).groupBy("block").applyInPandas(_scan(threshold), "n long, dup boolean")


def _kept(one: DataFrame, threshold: float, small: int) -> DataFrame:
    """(n) of the records that the scan keeps, by rounds.

    In a round those stay that are like no earlier undecided record, and those go that are like one that stays. This
    gives what the scan gives: whether a record is kept rests on earlier ones alone. Only whether there is such a record
    is asked, so that a group of alike records makes no pairs. At most ``small`` last ones are scanned in turn.
    """
    left, kept = one, None
    keys = cut(_keys(one).join(one.select("n", _record().alias("r")), "n"))
    while (n := left.count()) > small:
        mine = keys.join(left.select("n"), "n", "left_semi") if kept is not None else keys
        earlier = mine.select("key", F.col("n").alias("m"), F.col("r").alias("s"))
        alike = lambda side: (F.col("key") == F.col("other_key")) & (F.col(f"{side}.m") < F.col("n")) & (_exact("r", "s") | (F.round(similarity("r", "s"), 6) >= threshold))
        blocked = cut(mine.join(earlier.withColumnRenamed("key", "other_key").alias("e"), alike("e"), "left_semi").select("n").distinct())
        stay = cut(left.join(blocked, "n", "left_anti").select("n"))
        firm = mine.join(stay, "n", "left_semi").select(F.col("key").alias("other_key"), F.col("n").alias("m"), F.col("r").alias("s"))
        gone = mine.join(blocked, "n", "left_semi").join(firm.alias("e"), alike("e"), "left_semi").select("n").distinct()
        left = cut(left.join(blocked, "n", "left_semi").join(gone, "n", "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
    last = _scanned(left, threshold).where("not dup").select("n") if n else left.select("n")
    return last if kept is None else kept.unionByName(last)


def greedy(df: DataFrame, order: str, threshold: float = THRESHOLD, window: int | None = None, small: int = SMALL) -> DataFrame:
    """Mark records that repeat an earlier kept one, in the order of a column, exactly or at ``threshold``.

    Over NEITHER_EQUAL the scan is done by rounds over the cluster, whatever a phone has; from there down to 0.6 a phone is
    scanned in one task, as only equal phones are then necessary. Rows that are equal in all that is compared are folded
    before; of equal places in the order one comes first. With ``window``, likeness counts only to the last so many kept
    records, as a scan with bounded memory sees them, while exact repeats of any kept one go. Null fields count as empty.
    """
    rows = _prepared(df, order)
    one = cut(rows.groupBy(*KEY).agg(F.min("n").alias("n")))
    if threshold > NEITHER_EQUAL:
        kept = cut(_kept(one, threshold, small))
    elif window is None:
        kept = cut(_scanned(one, threshold).where("not dup").select("n"))
    else:
        raise ValueError(f"a window needs a threshold over {NEITHER_EQUAL}")
    if window is not None:
        kept = _windowed(rows, kept, threshold, window)
    mark = kept.select("n", F.lit(False).alias("is_duplicate"))
    return rows.join(mark, "n", "left").select(*df.columns, F.coalesce("is_duplicate", F.lit(True)).alias("is_duplicate"))


def _windowed(rows: DataFrame, kept: DataFrame, threshold: float, window: int) -> DataFrame:
    """(n) of the records that a scan keeps which compares with its last ``window`` kept ones.

    From a guess of what is kept follows each record's judgement, and from these the next guess. Every turn makes at least
    one more record right, in the order, and a guess that doesn't change is the scan's result.
    """
    all_ = cut(rows.select("n", *KEY))
    keys = cut(_keys(all_).join(all_.select("n", _record().alias("r")), "n"))
    while True:
        flagged = all_.select("n").join(kept.select("n", F.lit(1).alias("kept")), "n", "left").fillna({"kept": 0})
        before = cut(running(flagged, "n", "kept", "before"))
        mine = keys.join(before, "n")
        other = mine.where("kept = 1").select(F.col("key").alias("other_key"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("before").alias("b"))
        near = (F.round(similarity("r", "s"), 6) >= threshold) & (F.col("b") >= F.col("before") - window)
        dups = mine.join(other, (F.col("key") == F.col("other_key")) & (F.col("m") < F.col("n")) & (_exact("r", "s") | near), "left_semi").select("n").distinct()
        new = cut(all_.select("n").join(dups, "n", "left_anti"))
        same = new.join(kept, "n", "left_anti").isEmpty() and kept.join(new, "n", "left_anti").isEmpty()
        kept = new
        if same:
            return kept
