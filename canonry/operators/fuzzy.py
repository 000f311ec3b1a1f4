"""Registry lookup of names: exact, then either-way substring, then one edit-distance match."""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Words of classes of additives, whose use depends on conditions.
ADDITIVE = r"\bins\b|e\s?\d{3}|preservative|colour|color|flavour|flavor|sweetener|emulsifier|stabiliz|antioxidant|acidity\s+regulator|raising\s+agent|thickener|humectant"


def lookup(names: DataFrame, registry: DataFrame, distance: int = 2, least: int = 4, most_broadcast: int = 2_000, additive: str | None = None) -> DataFrame:
    """``name``, ``match``, ``how`` (exact, substring, typo, additive or none), ``confidence``.

    ``registry`` has ``entry`` (lower case) and ``ordinal``. Of several substrings the first
    entry wins; a typo counts only where one entry is nearest; what is left and matches
    ``additive`` is one by its class. Names are looked up once each, exact ones by an equi-join. The
    rest meets a registry of at most ``most_broadcast`` entries in a broadcast, and a larger one by
    an equi-join on short keys that every substring and every typo shares.
    """
    registry = registry.groupBy("entry").agg(F.min("ordinal").alias("ordinal"))
    distinct = names.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    exact = distinct.join(registry.select(F.col("entry").alias("key"), F.col("entry").alias("exact")), "key", "left")
    rest = exact.where("exact is null").select("name", "key")
    if registry.limit(most_broadcast + 1).count() <= most_broadcast:
        met = rest.join(F.broadcast(registry), F.contains("key", "entry") | F.contains("entry", "key") | (F.levenshtein("key", "entry", distance) >= 0))
    else:
        left, right = rest.select("name", "key", F.explode(_shared_keys("key", distance, True)).alias("__k")), registry.select("entry", "ordinal", F.explode(_shared_keys("entry", distance, False)).alias("__k"))
        met = left.join(right, "__k").select("name", "key", "entry", "ordinal").distinct()
    inside = F.min_by("entry", F.when((F.contains("key", "entry") | F.contains("entry", "key")) & (F.col("key") != ""), F.col("ordinal")))
    edits = F.when((F.length("key") >= least) & F.col("key").rlike("^[a-z ]+$"), F.levenshtein("key", "entry", distance))
    near = F.when(edits >= 0, F.struct(edits.alias("d"), "entry"))
    found = exact.join(met.groupBy("name").agg(inside.alias("inside"), F.sort_array(F.collect_set(near)).alias("near")), "name", "left")
    single = F.coalesce((F.size("near") > 0) & ((F.size("near") == 1) | (F.get("near", F.lit(1))["d"] > F.get("near", F.lit(0))["d"])), F.lit(False))
    of_class = F.coalesce(F.col("key").rlike(f"(?i){additive}"), F.lit(False)) if additive else F.lit(False)
    choose = lambda e, i, t, c, none: F.when(F.col("exact").isNotNull(), e).when(F.col("inside").isNotNull(), i).when(single, t).when(of_class, c).otherwise(none)
    return found.select(
        "name",
        F.coalesce("exact", "inside", F.when(single, F.get("near", F.lit(0))["entry"])).alias("match"),
        choose("exact", "substring", "typo", "additive", "none").alias("how"),
        choose(1.0, 0.85, 0.6, 0.7, 0.5).alias("confidence"),
    )


def _shared_keys(column: str, distance: int, name: bool) -> Column:
    """Keys of which two strings share one if one is part of the other, or if they are at most ``distance`` edits apart.

    A part shares its first letters (up to four) with a run of the whole. Of an entry cut into
    ``distance + 1`` segments an edit leaves one whole, at most ``distance`` places further.
    """
    c, n = F.col(column), F.length(column)
    part = F.concat(F.lit("p"), F.substring(c, 1, 4))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.concat(F.lit("p"), c.substr(i, k)))))
    k = distance + 1
    begin = lambda i, length: F.floor(i * length / k).cast("int") + 1
    key = lambda i, length, at: F.concat_ws(":", length.cast("string"), i.cast("string"), c.substr(at, begin(i + 1, length) - begin(i, length)))
    pieces = F.sequence(F.lit(0), F.lit(distance))
    if name:
        lengths, shifts = F.sequence(F.greatest(F.lit(1), n - distance), n + distance), F.sequence(F.lit(-distance), F.lit(distance))
        typo = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(pieces, lambda i: F.transform(shifts, lambda s: F.when(begin(i, m) + s >= 1, key(i, m, begin(i, m) + s)))))))
    else:
        typo = F.transform(pieces, lambda i: key(i, n, begin(i, n)))
    return F.array_distinct(F.filter(F.concat(F.array(part), runs, typo), lambda x: x.isNotNull()))


def band_tasks(hashes: int, widths: list[int], rows: int = 2_000_000, pairs: int = 4_000_000) -> tuple[int, int]:
    """Over how many tasks ``hashes`` are cut into keys, one for each of ``widths`` bits, and over how many those meet: ``rows`` keys a task, ``pairs`` of equal key if bits are even."""
    met = hashes * hashes * sum(2.0**-w for w in widths)
    made = ceil(hashes * len(widths) / rows)
    return max(1, made), max(1, made, ceil(met / pairs))


def near_hashes(hashes: DataFrame, most: int, bands: int, bits: int = 64) -> DataFrame:
    """``hash`` < ``other``, distinct hashes that differ in 1 to ``most`` bits, and their ``distance``.

    Cut into ``bands`` > ``most`` bands, a pair within the distance agrees on ``bands - most`` of them wholly, so an
    equi-join on every choice of that many bands finds all pairs. More bands make keys longer and rarer.
    """
    if bands <= most:
        raise ValueError("more bands than bits that may differ are needed")
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    band = lambda i: F.shiftrightunsigned("hash", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)
    choices = list(combinations(range(bands), bands - most))
    keys = F.array(*(F.struct(F.lit(k).alias("choice"), F.xxhash64(*map(band, chosen)).alias("key")) for k, chosen in enumerate(choices)))
    distinct = hashes.select("hash").distinct()
    spread, tasks = band_tasks(distinct.count(), [sum(edges[i + 1] - edges[i] for i in chosen) for chosen in choices])
    # Few bytes meet in many pairs, so sizes in bytes would leave all pairs to one task: the pairs give the number of tasks.
    banded = distinct.repartition(spread, "hash").select("hash", F.inline(keys)).repartition(tasks, "choice", "key")
    met = banded.join(banded.withColumnRenamed("hash", "other").hint("shuffle_hash"), ["choice", "key"])
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("other"))).cast("int")
    return met.where((F.col("hash") < F.col("other")) & (apart <= most)).select("hash", "other", apart.alias("distance")).distinct()


def near_classes(hashes: DataFrame, most: int, bands: int, bits: int = 64) -> DataFrame:
    """Near pairs of classes of equal hash by their smallest ids, ``a`` < ``b``, with ``distance``, ``a_images`` and ``b_images``.

    With ``class_of`` that is every pair of images, without a row for each.
    """
    size = hashes.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    x, y = size.select("hash", F.col("id").alias("i"), F.col("n").alias("m")), size.select(F.col("hash").alias("other"), F.col("id").alias("j"), F.col("n").alias("n"))
    met = near_hashes(hashes, most, bands, bits).join(x, "hash").join(y, "other")
    first = F.col("i") < F.col("j")
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance", F.when(first, F.col("m")).otherwise(F.col("n")).alias("a_images"), F.when(first, F.col("n")).otherwise(F.col("m")).alias("b_images"))


def copied_images(hashes: DataFrame, most: int, bands: int, least: float, bits: int = 64, opened: bool = False) -> DataFrame:
    """One row an image: its class (``copy_of``, the smallest id of its hash), how many others are within ``most`` bits, and the earlier image that it copies.

    ``hashes`` has ``id``, ``hash`` and ``ink`` (null is none). An earlier image counts if its hash is equal, or if both have at
    least ``least`` of ink; the nearest is taken, ties to the smallest id. That is the first of its class for
    all but the first itself, and for the first the least inked id of a near class: no pair of images is made.
    ``opened`` adds ``open_links``, how many of the others count, earlier or later.
    """
    inked = F.coalesce("ink", F.lit(0.0)) >= least
    size = hashes.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min(F.when(inked, F.col("id"))).alias("first_inked"), F.count_if(inked).alias("n_inked"))
    near = near_hashes(hashes, most, bands, bits)
    both = near.unionByName(near.select(F.col("other").alias("hash"), F.col("hash").alias("other"), "distance"))
    other = size.select(F.col("hash").alias("other"), F.col("n").alias("m"), F.col("n_inked").alias("m_inked"), F.col("first_inked").alias("source"))
    own = size.select("hash", "first")
    around = both.join(other, "other").join(own, "hash").groupBy("hash").agg(F.sum("m").alias("links"), F.sum("m_inked").alias("inked_links"), F.min(F.when(F.col("source") < F.col("first"), F.struct("distance", "source"))).alias("best"))
    told = hashes.select("id", "hash", inked.alias("inked")).join(size.select("hash", "first", "n"), "hash").join(around, "hash", "left")
    copy = F.col("id") > F.col("first")
    best = F.when(~copy & F.col("inked"), F.col("best"))
    open_links = [(F.col("n") - 1 + F.when(F.col("inked"), F.coalesce("inked_links", F.lit(0))).otherwise(0)).alias("open_links")] if opened else []
    return told.select("id", F.col("first").alias("copy_of"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.when(copy, F.col("first")).otherwise(best["source"]).alias("nearest"), F.when(copy, 0).otherwise(best["distance"]).alias("distance"), *open_links)


def nearest_in_grid(points: DataFrame, by: list[str], reach: float, k: int) -> DataFrame:
    """The k nearest others of each point by L1 distance, at most ``reach`` away: an equi-join on grid cells of that size."""
    cell = {"__cx": F.floor(F.col("x") / reach), "__cy": F.floor(F.col("y") / reach)}
    steps = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = points.withColumns(cell).select(*by, "id", "x", "y", "__cx", "__cy", F.inline(steps)).select(*by, "id", "x", "y", (F.col("__cx") + F.col("dx")).alias("__cx"), (F.col("__cy") + F.col("dy")).alias("__cy"))
    right = points.withColumns(cell).select(*by, F.col("id").alias("other"), F.col("x").alias("__x"), F.col("y").alias("__y"), "__cx", "__cy")
    d = F.abs(F.col("x") - F.col("__x")) + F.abs(F.col("y") - F.col("__y"))
    met = left.join(right, [*by, "__cx", "__cy"]).where((F.col("id") != F.col("other")) & (d <= reach)).withColumn("distance", d)
    w = Window.partitionBy(*by, "id").orderBy("distance", "other")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "id", "rank", "other", "distance")
