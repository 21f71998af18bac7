"""Near duplicates: banded MinHash, odd sketches, exact confirmation.

1. Each document becomes a set of hashed word shingles, folded into MinHash samples; groups of
   samples are band keys, and all samples flip bits of a parity bitmap (the odd sketch).
2. Equal sets form classes by a 128-bit digest; only one representative of a class goes on.
3. Representatives that share a band key meet the smallest document of that bucket (its hub). The
   population count of two XORed sketches estimates their similarity; pairs far below the threshold
   stop there, the others are confirmed on full sets. Components of these links settle most buckets
   with a number of comparisons linear in the bucket's size.
4. Of the documents in buckets that still span several components, those with too many shingles that
   no other of them has can't reach the threshold and leave (exact). In what remains, members outside
   a bucket's largest component are compared with each other, and once for all their buckets with
   that component, in cells of bounded size, inside tasks: sketch first, full sets next. Cells emit
   only links that join different components, so no pairs pile up.

Two sets at the threshold share no band key with a probability below 1e-6 at the default setting.

Edge cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; documents with a null id are returned unlinked with a null
component; repeated rows of one id are one node and come back once per row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import CACHE_WORDS, map_columns, stage_table, texts
from roundtide.llm.graph import components

BANDS, ROWS = 30, 4
SKETCH_BITS = 512
#: Estimates below this are not confirmed: seven standard deviations of 120 samples under 0.8.
SKETCH_FLOOR = 0.55
#: Shingles on one side of a cell of the last step; bounds its memory.
BLOCK_SHINGLES = 1 << 18
MASK = (1 << 64) - 1
SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingler(width: int):
    """A function from text to the sorted distinct 64-bit shingle hashes."""
    known: dict[bytes, int] = {}

    def word_hash(word: bytes) -> int:
        got = known.get(word)
        if got is None:
            if len(known) > CACHE_WORDS:
                known.clear()
            got = known[word] = xxhash.xxh64_intdigest(word)
        return got

    def shingles(text: str) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as defined
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(word_hash, words), np.uint64, len(words))
        n = min(width, len(h))
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(acc)

    return shingles


def signer(bands: int, rows: int):
    """A function from shingle hashes to (band keys, odd sketch)."""
    k = bands * rows
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    mul, add = (seeds[:k] | np.uint64(1))[:, None], seeds[k:, None]
    place = np.arange(k, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    band_no = np.arange(bands, dtype=np.uint64)

    def sign(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(k, MASK, np.uint64)
        for start in range(0, len(h), 4096):
            np.minimum(least, (h[None, start : start + 4096] * mul + add).min(axis=1), out=least)
        samples = mix(least + place)
        parity = np.bincount((samples >> np.uint64(32)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
        keys = band_no.copy()
        for r in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, r])
        return keys.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)

    return sign


def sketch_similarity(differing_bits: np.ndarray, samples: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the population count of two XORed odd sketches of ``samples`` samples each."""
    left = np.maximum(1 - 2 * differing_bits / bits, 1e-9)
    return 1 + bits / (4 * samples) * np.log(left)


def most_differing_bits(floor: float, samples: int, bits: int = SKETCH_BITS) -> int:
    """The largest population count whose estimate still reaches ``floor``."""
    counts = np.arange(bits + 1)
    return int(counts[sketch_similarity(counts, samples, bits) >= floor].max())


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    def make():
        shingles, sign = shingler(width), signer(bands, rows)

        def step(ids, text):
            out = [[], [], [], [], []]
            for i, t in zip(ids, text):
                h = shingles(t)
                keys, sketch = sign(h) if len(h) and i is not None else (None, None)
                digest = np.array([h.sum(), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes() if len(h) else None
                for column, value in zip(out, (i, len(h), digest, keys, sketch)):
                    column.append(value)
            return out

        return step

    return map_columns(texts(docs), make, SIGNATURE)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the wanted ids: (doc_id, shingles as packed 64-bit words)."""

    def make():
        shingles = shingler(width)
        return lambda ids, text: [ids, [shingles(t).tobytes() for t in text]]

    return map_columns(texts(docs).join(wanted, "doc_id", "left_semi"), make, "doc_id long, shingles binary").dropDuplicates(["doc_id"])


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = min(len(s), len(t)), max(len(s), len(t))
    if 100 * small < percent * large:
        return False
    shared = small + large - len(np.union1d(s, t))
    return 100 * shared >= percent * (small + large - shared)


def _bits_apart(a: str, b: str) -> F.Column:
    """Population count of two XORed 512-bit sketches, each eight longs."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _open_buckets(placed: DataFrame, least: int) -> DataFrame:
    """Buckets of several components, with the largest of them."""
    parts = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    return (
        parts.groupBy("band", "key")
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("k"),
            F.max_by("component", F.struct("n", "component")).alias("main"),
        )
        .where(F.expr(f"k > 1 and n >= {least}"))
        .select("band", "key", "main")
    )


def _cells(inside: DataFrame) -> DataFrame:
    """Rows of open buckets dealt into cells of bounded size, in each of which ``outer`` rows meet the others.

    Documents outside a bucket's largest component meet each other bucket by bucket, and meet the
    largest component once for all the buckets they share with it (band -1, the component as key).
    """
    outer = inside.where("component != main").select("band", "key", "doc_id", "component", "n_shingles", "main")
    around = F.lit(-1).alias("band"), F.col("main").alias("key"), "doc_id", "component", "n_shingles"
    left = outer.drop("main").unionByName(outer.select(*around).distinct())
    right = outer.drop("main").unionByName(inside.where("component = main").select(*around).distinct())

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("band", "key").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias(name))

    sizes = stage_table(blocks(left, "lefts").join(blocks(right, "rights"), ["band", "key"]), "cell-sizes")
    block = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = "band", "key", "doc_id", "component"
    lefts = left.join(sizes, ["band", "key"]).select(
        *columns, F.lit(True).alias("outer"), block("lefts").alias("against"), every("rights").alias("block")
    )
    rights = right.join(sizes, ["band", "key"]).select(
        *columns, F.lit(False).alias("outer"), every("lefts").alias("against"), block("rights").alias("block")
    )
    return lefts.unionByName(rights)


def _lonely(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Ids with so many shingles of their own among ``ids`` that the rest can't reach the threshold."""

    def make():
        def step(ids, packed):
            arrays = [np.frombuffer(p, np.uint64).view(np.int64) for p in packed]
            return [np.repeat(np.array(ids, np.int64), [len(a) for a in arrays]), np.concatenate(arrays) if arrays else []]

        return step

    inside = sets.join(ids, "doc_id", "left_semi")
    each = map_columns(inside, make, "doc_id long, shingle long", chunk=64)
    own = each.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1")
    own = own.groupBy("doc_id").agg(F.count("*").alias("own"))
    sizes = inside.select("doc_id", (F.octet_length("shingles") / 8).alias("size"))
    return own.join(sizes, "doc_id").where(F.expr(f"100 * (size - own) < {percent} * size")).select("doc_id")


def _blocks(percent: int, floor_bits: int):
    """Links between members of different components inside one block of a bucket."""
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def compare(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["doc_id", "outer"])
        bands = np.array([np.asarray(x) for x in pdf["bands"]])
        sketch = np.array([np.asarray(x) for x in pdf["sketch"]]).view(np.uint8)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        sizes = np.array([len(x) for x in sets])
        ids, comp = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
        outer, band = pdf["outer"].to_numpy(), int(pdf["band"].iloc[0])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        links = []
        inner = np.flatnonzero(~outer)
        for i in np.flatnonzero(outer):
            near = inner[comp[inner] != comp[i]]
            near = near[100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i])]
            near = near[ones[sketch[near] ^ sketch[i]].sum(axis=1, dtype=np.int64) <= floor_bits]
            shared = bands[near] == bands[i]  # in a bucket only the pairs that meet in no earlier one
            near = near[shared.any(axis=1) if band < 0 else shared.argmax(axis=1) == band]
            for j in near:
                x, y = find(comp[i]), find(comp[j])
                if x != y and linked(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept; a row per document."""
    floor_bits = most_differing_bits(SKETCH_FLOOR, bands * rows)
    signed = stage_table(signatures(docs, width, bands, rows), "signatures")
    sized = signed.where("digest is not null and doc_id is not null")
    classes = sized.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = stage_table(classes, "classes")
    reps = sized.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = stage_table(reps.select("doc_id", "n_shingles", "bands", "sketch"), "representatives")

    rows_of = reps.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    hubs = rows_of.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = stage_table(hubs.select("band", "key", "hub"), "hubs")
    members = stage_table(rows_of.join(hubs, ["band", "key"]), "bucket-members")
    sets = stage_table(_sets(docs, members.select("doc_id").distinct(), width), "shingle-sets")
    marks = reps.select("doc_id", "sketch", "n_shingles")

    pairs = members.where("doc_id != hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    near = (
        pairs.join(marks.toDF("a", "ma", "na"), "a")
        .join(marks.toDF("b", "mb", "nb"), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .where(_bits_apart("ma", "mb") <= floor_bits)
        .select("a", "b")
    )
    full = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def make_confirm():
        def step(a, b, sa, sb):
            keep = [
                (x, y) for x, y, s, t in zip(a, b, sa, sb)
                if linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent)
            ]
            return [[x for x, _ in keep], [y for _, y in keep]]

        return step

    links = stage_table(map_columns(full, make_confirm, "a long, b long"), "hub-links")
    first = stage_table(components(links), "components")

    # buckets that still span several components; a bucket of two has had its only comparison
    placed = members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    placed = stage_table(placed.select("band", "key", "doc_id", "n_shingles", "component"), "placed")
    mixed = stage_table(_open_buckets(placed, least=3), "mixed-buckets")
    left = placed.join(mixed.select("band", "key"), ["band", "key"], "left_semi")
    lonely = stage_table(_lonely(sets, left.select("doc_id").distinct(), percent), "lonely")
    left = stage_table(left.join(lonely, "doc_id", "left_anti"), "open-members")
    open_ = stage_table(_open_buckets(left, least=2), "open-buckets")
    inside = left.join(open_, ["band", "key"])
    filled = _cells(inside).join(reps.select("doc_id", "bands", "sketch"), "doc_id").join(sets, "doc_id")
    late = filled.groupBy("band", "key", "block", "against").applyInPandas(_blocks(percent, floor_bits), "a long, b long")
    late = stage_table(late, "late-links")
    # late links join components of the first links: a small graph of its own
    names = first.select("node", "component")
    ends = late.join(names.toDF("a", "ca"), "a", "left").join(names.toDF("b", "cb"), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    moved = names.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(names, "node", "left_anti")
    placed_all = moved.unionByName(alone).select(F.col("node").alias("class_id"), "component")
    named = classes.join(placed_all, "class_id", "left").select(
        "digest", "n_shingles", F.coalesce("component", "class_id").alias("component")
    )
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(named, ["digest", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
