"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Distinct lines get MinHash signatures of their character shingles; lines that agree in a band
are candidates; exact Jaccard similarities decide; connected components follow by the
distributed union-find of ``common``; the first line of each component stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import connected_components, forget, stage

#: Characters (UTF-16 units) of a shingle, and bytes of a unit.
SHINGLE, UNIT = 8, 2
#: Shingles in a row of work: the loop over them is compiled, and one aggregation step serves all.
BLOCK = 24
#: MinHash values of a line. A band joins four of them, any two bands share one at most; at a similarity
#: of 0.8 a pair agrees in one of the bands with a probability of 0.993.
VALUES, BANDS = 20, 16
#: Rows of one side of a tile of a bucket.
TILE_ROWS = 256
#: Crowded buckets get so many rounds of stars while a round leaves at most this share of their rows open.
STAR_ROUNDS, STILL_OPEN = 8, 0.9
#: 64-bit words of a set's parity bitmap: 2048 bits do not fill up with the some hundred shingles of a long line.
PARITY = 32
#: Words of the shorter ones that lines of a bucket meet with.
FOLDED = 16
#: A side is broadcast where it was counted to have at most so many numbers; else both are shuffled.
BROADCAST_NUMBERS = 2_000_000
#: What a blank line consists of, besides nothing.
BLANKS = " \t\r\x0b\x0c"


def targets() -> list[int]:
    """A fixed pseudo-random number for each of the VALUES hashes.

    The least of h XOR target over a set's hashes h is a MinHash: each element is
    equally likely to be nearest to the target.
    """
    out, x = [], 0x2545F4914F6CDD1D
    for _ in range(VALUES):
        for shift in (13, -7, 17):
            x ^= (x << shift if shift > 0 else x >> -shift) & (2**64 - 1)
        out.append(x - 2**63)
    return out


def bands() -> list[list[int]]:
    """The places of the four values of each band: shifts of one set whose differences are all different."""
    return [[(b * VALUES // BANDS + step) % VALUES for step in (0, 1, 4, 9)] for b in range(BANDS)]


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a staged table of numbers, marked for broadcast if its size allows."""
    return F.broadcast(df) if df.count() * len(df.columns) <= BROADCAST_NUMBERS else df


def never_null(df: DataFrame) -> DataFrame:
    """``df``, whose whole numbers are never null, in a form that says so: what is compiled for them tests no nulls."""
    return df.select(*[F.coalesce(c, F.lit(0).cast(kind)).alias(c) if kind in ("int", "bigint") else c for c, kind in df.dtypes])


def line_id(line: Column, salt: int = 0) -> Column:
    return F.xxhash64(line) if not salt else F.xxhash64(F.lit(salt), line)


def split_lines(docs: DataFrame, id_col: str, text_col: str, clashes: list[DataFrame]) -> DataFrame:
    """(doc, rid, pos, line, lid) of all lines that are not blank. rid: a hash of the whole text; lid: a
    hash of the line, taken anew where ``clashes`` list it."""
    text = F.col(text_col)
    # the outer form: for the plain one Spark asks first whether arrays are empty, and so makes them twice
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("rid"), F.posexplode_outer(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.where("doc IS NOT NULL").where(F.ltrim("line", F.lit(BLANKS)) != "").withColumn("lid", line_id(F.col("line")))
    for salt, clash in enumerate(clashes, 1):
        marked = clash.select("lid", F.lit(True).alias("clash"))
        lines = lines.join(marked, "lid", "left").withColumn("lid", F.when(F.col("clash"), line_id(F.col("line"), salt)).otherwise(F.col("lid"))).drop("clash")
    return lines


def in_blocks(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, at, h0, h1, ...): the 64-bit hashes of all shingles of each ``line``, BLOCK to a row; at: 1 in
    a line's first row. The last row repeats the last shingle; a line of fewer characters is its own only one."""
    width = SHINGLE * UNIT
    units = lines.select(*keep, F.encode("line", "UTF-16BE").alias("units")).withColumn("last", F.expr(f"greatest(length(units) - {width - 1}, 1)"))
    rows = units.select(*keep, "units", "last", F.explode_outer(F.expr(f"sequence(1, last, {UNIT * BLOCK})")).alias("at"))
    return rows.select(*keep, "at", *[F.xxhash64(F.expr(f"substring(units, least(at + {UNIT * k}, last), {width})")).alias(f"h{k}") for k in range(BLOCK)])


def signed(lines: DataFrame, by: list[str] | None = None, **more: Column) -> DataFrame:
    """(*by, *more, keys) for each group of ``lines``, whose ``line`` is one; keys: one for each band of the line's signature.

    by: all columns, if not given; so what was dealt by them is not dealt out again. Without ``line`` among
    them, no text is a key of the rows of work. more: aggregates of ``lines``, with ``at`` 1 in one row of work of each line.
    """
    by = by or lines.columns
    block = [F.col(f"h{k}") for k in range(BLOCK)]
    least = [F.min(F.least(*[h.bitwiseXOR(F.lit(c)) for h in block])).alias(f"m{k}") for k, c in enumerate(targets())]
    values = in_blocks(lines, [c for c in lines.columns if c in by or c != "line"]).groupBy(*by).agg(*[c.alias(k) for k, c in more.items()], *least)
    return values.select(*by, *more, F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in places]) for b, places in enumerate(bands())]).alias("keys"))


def shingles_of(line: Column) -> Column:
    """The hashes of a line's shingles, the ones of ``in_blocks``, repeats included, as an array made within its row.

    What takes the array, as array_distinct, belongs outside of lambdas: there it is compiled.
    """
    width = SHINGLE * UNIT
    places = lambda u: F.sequence(F.lit(1), F.greatest(F.length(u) - (width - 1), F.lit(1)), F.lit(UNIT))
    # bound as a lambda's argument, a line is encoded once, not for each shingle
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), lambda u: F.transform(places(u), lambda at: F.xxhash64(F.substring(u, at, F.lit(width))))), F.lit(0))


def maps_of(texts: DataFrame) -> DataFrame:
    """(lid, n, w0, w1, ...), staged: the size and the parity bitmap of each line's set of shingles."""
    sets = texts.repartition("lid").select("lid", F.array_distinct(shingles_of(F.col("line"))).alias("set"))
    hashes = sets.select("lid", F.explode_outer("set").alias("h"))
    words = hashes.groupBy("lid", (F.shiftrightunsigned("h", 6) % PARITY).alias("k")).agg(F.count("*").alias("n"), F.bit_xor(F.expr("shiftleft(1L, CAST(h & 63 AS int))")).alias("bits"))
    of = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}")
    return stage(words.groupBy("lid").agg(F.sum("n").alias("n"), *map(of, range(PARITY))), "maps")


def may_be_similar(threshold: float, words: int = PARITY) -> Column:
    """Whether the sizes and bitmaps of rows x and y, from ``maps_of`` or ``folded``, allow the similarity:
    bitmaps never differ in more bits than sets do in elements."""
    a, b = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(words)), F.lit(0))
    return (F.least(a, b) >= threshold * F.greatest(a, b)) & (apart * (1 + threshold) <= (a + b) * (1 - threshold) + 1e-6)


def folded(maps: DataFrame) -> DataFrame:
    """``maps`` with bitmaps of FOLDED words, which are parity bitmaps as well."""
    word = lambda k: functools.reduce(Column.bitwiseXOR, [F.col(f"w{j}") for j in range(k, PARITY, FOLDED)]).alias(f"w{k}")
    return maps.select("lid", "n", *[word(k) for k in range(FOLDED)])


def likely_pairs(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n), staged: those of the staged pairs (a, b) that may be similar; n: the sum of their sets' sizes."""
    count = pairs.count()
    side = lambda df, columns: F.broadcast(df) if count * columns <= BROADCAST_NUMBERS else df
    x, y = (never_null(maps).alias(k) for k in "xy")
    met = side(side(pairs, 2).join(x, F.col("a") == F.col("x.lid")), PARITY + 4).join(y, F.col("b") == F.col("y.lid"))
    return stage(met.where(may_be_similar(threshold)).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n")), "likely")


def least_shared(n: Column, threshold: float) -> Column:
    """The smallest s with s >= threshold * (n - s), for sets of n elements in all: so many shared ones make them similar."""
    near = F.floor(n * (threshold / (1 + threshold)))
    return F.get(F.filter(F.sequence(near - 1, near + 2), lambda s: s >= threshold * (n - s)), F.lit(0))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those of the staged pairs (a, b, n), from ``likely_pairs``, whose sets of shingles are similar; staged.

    Texts, an eighth of their sets, meet first and are dealt out by pairs, so that a line with many
    partners is dealt to many tasks; each pair's two sets are made there.
    """
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = F.size(F.array_intersect(shingles_of(F.col("x")), shingles_of(F.col("y"))))
    return stage(both.repartition(tasks, "a", "b").where(shared >= least_shared(F.col("n"), threshold)).select("a", "b"), "links")


def open_rows(large: DataFrame, components: DataFrame) -> DataFrame:
    """(key, lid, c, label), staged: the rows of ``large`` in buckets that hold several components."""
    labelled = stage(large.join(components, "lid", "left").withColumn("label", F.coalesce("component", "lid")).drop("component"), "labelled")
    several = stage(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "several")
    live = stage(labelled.join(several, "key", "left_semi"), "live")
    forget(labelled, several)
    return live


def star_pairs(live: DataFrame, turn: int) -> DataFrame:
    """(a, b), staged: all rows of a bucket with one of it, another one each turn, unless one component has both."""
    pivots = live.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "lid").alias("h"), F.col("lid").alias("pivot"), F.col("label").alias("its"))).alias("p"))
    pivots = stage(pivots.select("key", "p.pivot", "p.its"), "pivots")
    pairs = stage(live.join(pivots, "key").where("label <> its").select(F.greatest("lid", "pivot").alias("a"), F.least("lid", "pivot").alias("b")).distinct(), "pairs")
    forget(pivots)
    return pairs


def unmet_pairs(live: DataFrame, keyed: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """(a, b), staged: the pairs of different components that share a bucket of ``live``, from ``open_rows``, and may be similar.

    Blocks of about TILE_ROWS rows of a bucket meet in tiles, each a key of a join, so a bucket is dealt
    to as many tasks as it needs. A pair is made in the first bucket that both lines are in, not in
    each: that one is live too, as it holds two components, or held no other line and was decided.
    """
    blocks = F.ceil(F.col("c") / TILE_ROWS).cast("int")
    ids = stage(live.select("lid").distinct(), "ids")
    few = small_side(ids)
    keys = keyed.select("lid", "keys").join(few, "lid", "left_semi")
    lines = stage(folded(maps.join(few, "lid", "left_semi")).join(keys, "lid"), "lines")
    dealt = stage(live.withColumn("last", blocks - 1).withColumn("own", F.pmod(F.xxhash64("lid"), F.col("last") + 1).cast("int")).join(lines, "lid"), "dealt")
    plain = never_null(dealt)
    x = plain.withColumnRenamed("own", "i").withColumn("j", F.explode(F.sequence("i", "last"))).alias("x")
    y = plain.withColumnRenamed("own", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).alias("y")
    tile = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    unmet = ((F.col("x.i") < F.col("x.j")) | (F.col("x.lid") > F.col("y.lid"))) & (F.col("x.label") != F.col("y.label"))
    first = F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == F.col("x.key")
    met = x.join(y, tile & unmet & may_be_similar(threshold, FOLDED) & first)
    rest = stage(met.select(F.greatest("x.lid", "y.lid").alias("a"), F.least("x.lid", "y.lid").alias("b")).distinct(), "rest")
    forget(ids, lines, dealt)
    return rest


def near_lines(distinct: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """(lid, component), staged: distinct lines with a near-duplicate; component is the smallest lid reachable.

    distinct: (lid, line), repeats allowed, keyed: (lid, keys), staged. Similarity: Jaccard of the sets of shingles.
    Most keys are alone: they are counted without their lines, which are looked up for the others only.
    In a bucket each line first meets the smallest, then, while buckets hold several components, one
    line after another: so large groups of similar lines are joined with few pairs. All pairs of
    different components that are left in a bucket are compared at last, so every pair in a bucket is
    decided.
    """
    entries = keyed.select("lid", F.explode("keys").alias("key"))
    several = stage(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "several")
    shared = stage(entries.join(small_side(several), "key").select("key", "lid"), "shared")
    buckets = stage(shared.groupBy("key").agg(F.min("lid").alias("least"), F.count("*").alias("c")), "buckets")
    met = stage(shared.join(buckets, "key").select("key", "lid", "least", "c"), "met")
    large = met.where("c > 2").select("key", "lid", "c")
    stars = met.where("lid <> least").select(F.col("lid").alias("a"), F.col("least").alias("b"))
    pairs = stage(stars.distinct(), "pairs")
    needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct(), "needed")
    texts = stage(distinct.select("lid", "line").join(small_side(needed), "lid", "left_semi").distinct(), "texts")
    maps = maps_of(texts)
    likely = likely_pairs(pairs, maps, threshold)
    links = [verified(likely, texts, threshold)]
    components = connected_components(links[0])
    live = open_rows(large, components.withColumnRenamed("node", "lid"))
    forget(several, shared, buckets, met, pairs, needed, likely)
    rows, turn = live.count(), 0
    while rows:
        pairs = star_pairs(live, turn) if turn < STAR_ROUNDS else unmet_pairs(live, keyed, maps, threshold)
        likely = likely_pairs(pairs, maps, threshold)
        more = verified(likely, texts, threshold)
        forget(pairs, likely)
        before, found = rows, not more.isEmpty()
        if found:
            links.append(more)
            forget(components)
            components = connected_components(functools.reduce(DataFrame.unionByName, links))
        if turn >= STAR_ROUNDS:
            break
        if found:
            still = open_rows(live.drop("label"), components.withColumnRenamed("node", "lid"))
            forget(live)
            live, rows = still, still.count()
        turn = turn + 1 if rows <= STILL_OPEN * before else STAR_ROUNDS
    forget(live, texts, maps, *links)
    out = components.withColumnRenamed("node", "lid")
    out.staged_in = components.__dict__.pop("staged_in")
    return out


def line_check(line: Column) -> Column:
    """A hash that tells apart different lines with one ``line_id``: of the text after its own CRC and length."""
    return F.xxhash64(F.crc32(line), F.octet_length(line), line)


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Lines (doc, rid, pos, line, lid); staged, the different ones (lid, n, first_doc, clash, keys).

    Lines are signed where documents are read, and only numbers are dealt out. Hashes name
    lines: where two different ones, by a second hash, have one lid, those of them are hashed
    anew until all are apart.
    """
    clashes: list[DataFrame] = []
    while True:
        lines = split_lines(docs, id_col, text_col, clashes)
        named = lines.select("doc", "line", "lid", line_check(F.col("line")).alias("check"))
        groups = signed(named, ["lid"], n=F.count(F.when(F.col("at") == 1, 1)), first_doc=F.min("doc"), lo=F.min("check"), hi=F.max("check"))
        distinct = stage(groups.select("lid", "n", "first_doc", (F.col("lo") != F.col("hi")).alias("clash"), "keys"), "distinct")
        clash = stage(distinct.where("clash").select("lid"), "clash")
        if clash.isEmpty():
            forget(clash)
            return lines, distinct
        forget(distinct)
        clashes.append(clash)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """(doc, rid, drops), staged: for documents that lose lines, the places of these lines from 0.

    Of each component of equal and similar lines the first one stays: in the document with the
    smallest id, at the first place there.
    """
    lines, distinct = distinct_lines(docs, id_col, text_col)
    components = near_lines(lines, distinct, threshold)
    groups = distinct.join(components, "lid", "left").where("n > 1 OR component IS NOT NULL").select("lid", F.coalesce("component", "lid").alias("component"), "first_doc")
    groups = stage(groups, "groups")
    forget(distinct, components)
    keepers = stage(groups.groupBy("component").agg(F.min("first_doc").alias("keeper")), "keepers")
    kept_in = stage(groups.select("lid", "component").join(keepers, "component"), "kept_in")
    there = stage(lines.select("doc", "rid", "pos", "lid").join(small_side(kept_in), "lid").select("doc", "rid", "pos", "component", "keeper"), "there")
    at_home = there.where("doc = keeper")
    first = at_home.groupBy("component").agg(F.min(F.struct("rid", "pos")).alias("kept"))
    own = at_home.join(stage(first, "first"), "component").where((F.col("rid") != F.col("kept.rid")) | (F.col("pos") != F.col("kept.pos"))).select("doc", "rid", "pos")
    gone = there.where("doc <> keeper").select("doc", "rid", "pos").unionByName(own)
    drops = stage(gone.groupBy("doc", "rid").agg(F.collect_set("pos").alias("drops")), "drops")
    forget(groups, keepers, kept_in, there)
    return drops


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of ``text_col``, and n_lines and n_dropped added.

    Lines are parted by \\n; blank ones (white space, \\r included) are neither compared nor dropped.
    Null and empty texts stay as they are, with 0 or 1 lines. Equal rows keep the same
    lines; rows that repeat an id with different texts come in the order of their texts' hashes.
    Rows with a null id neither drop nor displace lines. Columns n_lines and n_dropped
    of ``docs`` are replaced; other extra columns stay, whatever their names.
    """
    drops = dropped_lines(docs, id_col, text_col, threshold)
    numbers = drops.agg(F.sum(F.size("drops") + 2)).first()[0] or 0
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("rid"))
    marked = rows.join(F.broadcast(drops) if numbers <= BROADCAST_NUMBERS else drops, ["doc", "rid"], "left")
    of = lambda c: F.col("row").getField(c)
    parts = F.split(of(text_col), "\n")
    kept = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "drops")
    # bound as a lambda's argument, a text is split once, not for each line
    left = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    added = ("n_lines", "n_dropped")
    return marked.select(
        *[F.when(F.col("drops").isNull(), of(c)).otherwise(left).alias(c) if c == text_col else of(c).alias(c) for c in docs.columns if c not in added],
        F.coalesce(F.octet_length(of(text_col)) - F.octet_length(F.replace(of(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that are similar (0.8) to one in a document before or above."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text"))
