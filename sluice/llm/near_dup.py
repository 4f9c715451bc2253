"""Near-duplicate join: Jaccard similarity of word 5-grams at or above a threshold, by pruned MinHash candidates.

1. Each document becomes its set of word 5-grams (64-bit hashes), a MinHash signature and band keys. Documents with
   one and the same set are one representative from here on, however many they are.
2. Representatives that share a band key meet in blocks of bounded size. Their MinHash values are compared a step at a
   time, and a pair is dropped once the posterior probability that its similarity reaches the threshold (uniform prior,
   binomial matches) is below a tolerance. Of the pairs left, only enough to connect their members leave the block.
3. The connected parts of that graph are what may be similar. Within each, again in blocks, all pairs are verified
   exactly on the 5-gram sets; what leaves a block is a count of links and one edge per representative, never the pairs.

A block holds BLOCK representatives on average, and a bucket or part of g blocks is dealt out as g * (g + 1) / 2 pairs
of blocks, so one large group is shared by many tasks and no pair of it is left out.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, drop_rows, hot_keys, join_groups, join_unique, map_batches, materialise, pick_ids

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: MinHash values compared between two looks at the posterior, and the tolerance of the posterior.
STEP = 25
TOLERANCE = 1e-5
BLOCK = 512

_SPACE = 32
#: Bytes that are part of a word: ASCII letters and digits, and all bytes of the other characters that are left.
_WORD_BYTES = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else _SPACE for i in range(256))
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_state: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _constants() -> dict[str, np.ndarray]:
    if not _state:
        _state["up"], _state["down"] = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
        seeds = np.arange(1, HASHES + WORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        odd = _mix(seeds) | np.uint64(1)
        _state["place"], _state["minhash"] = odd[:WORDS], odd[WORDS:]
    return _state


@cache
def _apart() -> np.ndarray:
    """For each code point, whether it sets words apart beyond ASCII: white space, controls and punctuation."""
    kinds = ("Cc", "Zs", "Zl", "Zp", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")
    return np.fromiter((c >= 0x80 and unicodedata.category(chr(c)) in kinds for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@cache
def _latin_apart() -> bytes:
    return bytes(_SPACE if apart else c for c, apart in enumerate(_apart()[:256]))


def word_bytes(text: str) -> bytes:
    """The text in lower case as UTF-8, with a space for each byte or character that sets words apart, and one at both
    ends."""
    low = " " + text.lower() + " "
    if not low.isascii():
        try:
            low = low.encode("latin-1").translate(_latin_apart()).decode("latin-1")
        except UnicodeEncodeError:
            points = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
            low = np.where(_apart()[points], np.uint32(_SPACE), points).tobytes().decode("utf-32-le")
    return low.encode("utf-8", "replace").translate(_WORD_BYTES)


def word_hashes(text: str | bytes, prefix: int = 0) -> np.ndarray:
    """One hash for each word in order, lower-cased; what is not a letter or digit sets words apart in ASCII, and white
    space, controls and punctuation beyond it. Bytes are taken as what ``word_bytes`` gives.

    With ``prefix``, of the first so many bytes of each word.
    """
    k = _constants()
    raw = word_bytes(text) if isinstance(text, str) else text
    data = np.frombuffer(raw, np.uint8)
    word = data != _SPACE
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # whole words, at most a chunk of bytes; a longer word is hashed by itself
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + _CHUNK, "right")))
        s, e = starts[at:stop] - first, ends[at:stop] - first
        if e[-1] > _CHUNK:
            out[at] = int.from_bytes(hashlib.blake2b(raw[starts[at] : ends[at]], digest_size=8).digest(), "little")
        else:
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(data[first : first + e[-1]] * k["up"][: e[-1]], out=sums[1:])
            out[at:stop] = _mix((sums[e] - sums[s]) * k["down"][s] + (e - s).astype(np.uint64))
        at = stop
    return out


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of word 5-grams; a shorter text with a word has one, of all its words."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        out += words[i : i + n] * _constants()["place"][i]
    return np.unique(_mix(out))


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    odd = _constants()["minhash"]
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(grams), 2048):
        np.minimum(best, ((grams[i : i + 2048, None] * odd) >> np.uint64(32)).min(axis=0), out=best)
    return best.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (rows of ``sig``)."""
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for i in range(ROWS):
        key = _mix(key * np.uint64(_BASE) + bands[:, :, i])
    return key.view(np.int64)


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def short(sig: np.ndarray) -> bytes:
    """A signature's last bytes: different values agree in 1 of 256, which can only let more pairs through the pruning."""
    return (sig & np.uint32(0xFF)).astype(np.uint8).tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """After each step, the fewest matches at which P(similarity >= threshold) is still at the tolerance.

    With a uniform prior, m matches of n give Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(step, hashes + 1, step)]


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a group ends, with the row numbers at which groups begin (and the end), from sorted input."""
    held: list[pa.RecordBatch] = []

    def begins(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last, first = held[-1], held[0]
        if len(held) > 1 and all(last.column(k)[-1].as_py() == first.column(k)[0].as_py() for k in keys):
            continue  # all of one group so far
        whole = pa.concat_batches(held)
        at = begins(whole)
        held = [whole.slice(at[-1])]
        if len(at) > 1:
            yield whole.slice(0, at[-1]), at
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.append(begins(whole), whole.num_rows)


def connect(labels: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Merge the parts of ``others`` into that of ``i``; one member of each part that was apart."""
    names, where = np.unique(labels[others], return_index=True)
    apart = names != labels[i]
    labels[np.isin(labels, names)] = labels[i]
    return others[where[apart]].tolist()


def candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 within one pair of blocks: edges that connect whatever survives the pruning."""
    need = least_matches()
    for batch, begin in groups_of(batches, ("key", "blocks")):
        rep, size = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
        first, cross = batch.column("first").to_numpy(zero_copy_only=False), batch.column("cross").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        left, right = [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            labels = np.arange(b - a)
            for i in range(b - a):
                if cross[a] and not first[a + i]:
                    continue
                ok = labels != labels[i]
                ok &= ~first[a:b] if cross[a] else np.arange(b - a) > i
                n = size[a:b]
                ok &= np.minimum(n, n[i]) >= THRESHOLD * np.maximum(n, n[i]) - 1e-9
                alive = np.flatnonzero(ok)
                same = np.zeros(len(alive), np.int64)
                for k, least in enumerate(need):
                    if not len(alive):
                        break
                    part = slice(k * STEP, (k + 1) * STEP)
                    same += (sig[a + alive, part] == sig[a + i, part]).sum(axis=1)
                    keep = same >= least
                    alive, same = alive[keep], same[keep]
                if len(alive):
                    found = connect(labels, i, alive)
                    left += [rep[a + i]] * len(found)
                    right += [rep[a + j] for j in found]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m))
    width = max(64, (1 << 22) // m)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        dense = np.zeros((m, width), np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return out


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 within one pair of blocks: (rep, links, root) for each representative with a link in it."""
    for batch, begin in groups_of(batches, ("key", "blocks")):
        rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
        first, cross = batch.column("first").to_numpy(zero_copy_only=False), batch.column("cross").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("grams").to_pylist()]
        again = np.append(False, rep[1:] == rep[:-1])  # a document that the table holds more than once
        again[begin[:-1]] = False
        out: list[list[int]] = [[], [], []]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            own = sets[a:b]
            n = np.array([len(s) for s in own], np.float64)
            both = shared_counts(own)
            near = both * (1 + THRESHOLD) >= THRESHOLD * (n[:, None] + n) - 1e-6
            np.fill_diagonal(near, False)
            if cross[a]:
                near &= first[a:b, None] != first[a:b]
            near[again[a:b]] = near[:, again[a:b]] = False
            links = near @ copies[a:b]
            labels = np.arange(b - a)
            for i in np.flatnonzero(links).tolist():
                connect(labels, i, np.flatnonzero(near[i]))
            linked = np.flatnonzero(links)
            out[0] += rep[a + linked].tolist()
            out[1] += links[linked].tolist()
            out[2] += rep[a + labels[linked]].tolist()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "links", "root"])


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, digest, n, sig, bands) of each document; n is 0 and the rest empty where a text has no word.

    ``tie`` is a hash of the text, which with doc_id tells rows apart.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, digests, sigs = [], [], []
                for text in part.column("text").to_pylist():
                    grams = shingles(text or "")
                    sizes.append(len(grams))
                    digests.append(set_digest(grams) if len(grams) else b"")
                    sigs.append(signature(grams))
                keys = band_keys(np.stack(sigs))
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array([short(s) for s in sigs], pa.binary()), bands],
                    ["doc_id", "tie", "digest", "n", "sig", "bands"],
                )

    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return map_batches(rows, made, "doc_id bigint, tie bigint, digest binary, n bigint, sig binary, bands array<bigint>")


def with_grams(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, grams): the 5-gram set itself; of rows read together with one doc_id and one set, the first."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: dict[tuple[int | None, bytes], np.ndarray] = {}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    grams = shingles(text or "")
                    found.setdefault((doc_id, set_digest(grams)), grams)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array([g for _, g in found], pa.binary()),
                        pa.array([g.tobytes() for g in found.values()], pa.binary()),
                    ],
                    ["doc_id", "digest", "grams"],
                )

    return map_batches(docs, made, "doc_id bigint, digest binary, grams binary")


def in_blocks(members: DataFrame, total: int) -> DataFrame:
    """Deal the members (key, rep) of each key out to pairs of blocks: adds blocks, first (side) and cross.

    Only keys with two or more members stay.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sized = join_groups(members, sizes, "key", "m", total).where(F.col("m").isNotNull())
    count = F.ceil(F.col("m") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rep"), count)
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select(
        "key", "rep", (low * (1 << 31) + high).alias("blocks"), (F.col("own") == low).alias("first"), (low != high).alias("cross")
    )


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """(node, label): the smallest node of each connected part; ``at_most`` is the most edges there can be.

    Each level hooks every node to its smallest neighbour if that is smaller, follows the hooks to their roots, and goes
    on with the edges that are left between roots, each once; so the edges shrink from level to level. A node that is the
    root of many, or an end of many edges, is no join key of one task. Tables are written in as few files as their rows
    need, but for the first where ``at_most`` is not told.
    """

    def between(pairs: DataFrame, at_most: int | None = None) -> DataFrame:
        ordered = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return materialise(ordered.distinct(), "edges", at_most=at_most)

    def step(upper: DataFrame) -> DataFrame:
        return upper.select(F.col("node").alias("up"), F.col("up").alias("far"))

    left, levels = between(edges.select("a", "b"), at_most), []
    while (count := left.count()) or not levels:
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = materialise(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "hooks", at_most=2 * count)
        while True:
            hops = join_unique(roots, step(roots), "up", hot_keys(roots, "up"))
            followed = hops.select("node", F.col("far").alias("up"), (F.col("far") < F.col("up")).alias("moved"))
            roots = materialise(followed, "hooks", at_most=2 * count)
            if roots.where("moved").isEmpty():
                break
            roots = roots.select("node", "up")
        roots = roots.select("node", "up")
        levels.append((roots, 2 * count))
        of = lambda end: roots.select(F.col("node").alias(end), F.col("up").alias(f"{end}_root"))  # noqa: B023, E731
        moved = join_unique(join_unique(left, of("a"), "a", hot_keys(left, "a")), of("b"), "b", hot_keys(left, "b"))
        left = between(moved.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), count)
    labels = levels.pop()[0].withColumnRenamed("up", "label")
    while levels:
        later = labels.select(F.col("node").alias("up"), "label")
        lower, nodes = levels.pop()
        named = join_unique(lower, later, "up", hot_keys(lower, "up"), "left")
        labels = materialise(named.select("node", F.coalesce("label", "up").alias("label")), "labels", at_most=nodes)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, class_size.

    Two documents are linked when the Jaccard similarity of their sets of word 5-grams is THRESHOLD or more; words are
    lower-cased, and white space and punctuation are passed over. n_links counts a document's linked documents, copies each.
    class_id is the smallest doc_id of those connected by links, class_size their number. A text without a word (null,
    empty) has no links and is a class of its own; a text of under 5 words is linked to texts with the same words.
    Repeated rows are documents of their own and linked. An empty table gives an empty result. Extra columns are
    ignored. Every pair found is exact; a pair at the threshold escapes all bands with a chance of 5e-5, and the
    pruning with one near its tolerance, both less for more similar pairs.
    """
    return classified(docs).select("doc_id", "class_id", "n_links", "class_size")


def classified(docs: DataFrame) -> DataFrame:
    """What ``near_duplicates`` tells, with ``tie`` (a hash of the text) and ``label``, which names a class even where
    ids are null or repeated (null for a text without a word)."""
    sketches = materialise(sketched(docs).withColumn("row_no", F.monotonically_increasing_id()), "sketches")
    documents = sketches.count()
    groups = materialise(
        sketches.where("n > 0")
        .groupBy("digest")
        .agg(F.min("row_no").alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")),
        "representatives",
        at_most=documents,
    )
    total = groups.count()
    signed = sketches.select(F.col("row_no").alias("rep"), "n", "sig", "bands")
    banded = signed.select("rep", "bands").join(groups.select("rep"), "rep", "left_semi").select(F.explode("bands").alias("key"), "rep")
    met = in_blocks(banded, total * BANDS).join(signed.select("rep", "n", "sig"), "rep")
    met = met.repartition("key", "blocks").sortWithinPartitions("key", "blocks", "rep")
    parts = components(map_batches(met, candidate_edges, "a bigint, b bigint"))
    named = sketches.select(F.col("row_no").alias("node"), F.col("doc_id").alias("own_id"), "digest")
    joined = materialise(parts.join(groups.select(F.col("rep").alias("node"), "copies"), "node").join(named, "node"), "parts", at_most=total)
    dealt = in_blocks(joined.select(F.col("label").alias("key"), F.col("node").alias("rep")), total)
    placed = dealt.join(joined.select(F.col("node").alias("rep"), "copies", "own_id", F.col("digest").alias("own_digest")), "rep")
    texts = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = with_grams(pick_ids(texts, joined.select(F.col("own_id").alias("doc_id")), total))
    held = placed.join(sets, (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    held = held.select("key", "blocks", "rep", "first", "cross", "copies", "grams")
    dealt = held.repartition("key", "blocks").sortWithinPartitions("key", "blocks", "rep")
    counted = materialise(map_batches(dealt, verified, "rep bigint, links bigint, root bigint"), "links")
    classes = components(counted.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), counted.count())
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    labelled = materialise(
        groups.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
        .withColumn("links", F.coalesce("links", F.lit(0))),
        "labelled",
        at_most=total,
    )
    by_class = labelled.groupBy("label").agg(
        F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members")
    )
    full = materialise(join_groups(labelled, by_class, "label", "members", total), "classes", at_most=total)
    rows = sketches.select("doc_id", "tie", "digest", "n")
    told = join_groups(rows.where("n > 0"), full.select("digest", "class_id", "class_size", "links", "copies", "label"), "digest", "copies", documents)
    worded = told.select("doc_id", "tie", "label", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size")
    alone = [F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size")]
    return worded.unionByName(rows.where("n = 0").select("doc_id", "tie", *alone))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, that with the smallest doc_id; all columns stay.

    Rows are told apart by doc_id and text, so an id that stands on several texts loses none but copies. Of rows of a
    class with the same smallest doc_id one stays. A null doc_id ranks last. Rows without a word stay.
    """
    shared = materialise(classified(docs).where("class_size > 1").select("doc_id", "tie", "label"), "shared")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("first")
    stays = shared.groupBy("label").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.tie").alias("__other"))
    rows = shared.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__other"))
    marked = rows.join(stays, same, "left").withColumn("stays", F.col("__other").isNotNull()).select("doc_id", "tie", "rows", "stays")
    judged = materialise(marked, "judged", at_most=shared.count())
    return drop_rows(docs, judged.where("not stays"), judged.where("stays and rows > 1"))
