"""MinHash near-dedup: HyperMinHash sketches, banded, estimated, then confirmed on full shingle sets.

Method: each 5-word shingle falls into one of 128 buckets; a bucket keeps its smallest hash compressed to a count of
leading zeros (6 bits) and the 10 mantissa bits behind the leading one. 25 bands of 5 compressed registers propose
candidates (for them an empty bucket borrows from another, so that bands of short texts select as well); the share of equal registers, corrected for chance collisions of compressed registers, is the Jaccard
estimate; candidates more than five standard errors below the threshold are dropped, the others are confirmed by
exact intersection and union of the whole sets. Linked documents form components.

Equal sets collapse first, so copies cost one representative. A band bucket proposes its members to its smallest
member only; a second pass takes, in buckets that are still in several components, every pair across components
(large buckets in blocks), so no link between different texts is lost and groups of near copies are not expanded.

Defined cases: null, empty or blank text has no shingles, is linked with nothing and kept; with one to four words
the whole sequence is the one shingle; rows that repeat a doc_id are one document; a null id is linked with nothing,
its component is null and it is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

K = 5
PERCENT = 85  # link at 100 * intersection >= 85 * union
BUCKETS, BANDS, WIDTH, MANTISSA = 128, 25, 5, 10
EMPTY = 0xFFFF
ERRORS = 5.0  # standard errors that an estimate may lie below the threshold
BLOCK = 256  # members of a large band bucket, or of a hub, that one group takes
SMALL = 64  # members of a small band bucket
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


def shingles(data: list[bytes], k: int = K):
    """(owner, hash) of the distinct shingles of each text, in order of owner and hash."""
    words = [x.lower().split() for x in data]
    lengths = np.array([len(x) for x in words], np.int64)
    base = core.hash_words([w for x in words for w in x])
    at = core.spans(lengths, k)
    owner, value = core.owners(lengths)[at], core.rolling(base, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = [i for i, n in enumerate(lengths) if 0 < n < k]
    if short:
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, core.hash_words([b" ".join(words[i]) for i in short]) ^ _SALT])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def registers(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers (n x 128): leading zeros and mantissa of the smallest hash of each bucket."""
    least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    h = core.mix(value, np.full(len(value), _SALT))
    np.minimum.at(least, owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), h >> np.uint64(7))
    field = 64 - 7
    top = np.frexp(least.astype(np.float64))[1]  # bit length, one too many where the float rounded up
    top -= (top > 0) & (least >> (np.maximum(top, 1) - 1).astype(np.uint64) == 0)
    zeros = np.minimum(field - top, 62)
    kept = field - zeros  # bits from the leading one down
    down = np.maximum(kept - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> down) & np.uint64((1 << MANTISSA) - 1)
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    return np.where(least == np.iinfo(np.uint64).max, EMPTY, out).astype(np.uint16).reshape(n, BUCKETS)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that compressed registers of unrelated sets of these sizes are equal."""
    i = np.arange(48)
    def exact(n):
        at_least = 1 - (1 - 0.5 ** i) ** (np.maximum(n, 1)[:, None] / BUCKETS)
        return at_least[:, :-1] - at_least[:, 1:]
    return (exact(n_a) * exact(n_b)).sum(1) * 0.5 ** MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """(Jaccard estimate corrected for collisions, its standard error at the threshold) for rows of registers."""
    some = (a != EMPTY) | (b != EMPTY)
    used = np.maximum(some.sum(1), 1)
    equal = ((a == b) & some).sum(1) / used
    p = chance(n_a, n_b)
    t = PERCENT / 100
    return np.clip((equal - p) / (1 - p), 0, 1), np.sqrt(t * (1 - t) / used)


def _sketch(batches):
    for batch in core.slices(batches):
        data = core.blobs(batch)
        owner, value = shingles(data)
        n = np.bincount(owner, minlength=len(data))
        first, second = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
        np.add.at(first, owner, core.mix(value, value))
        np.add.at(second, owner, core.mix(value ^ _SALT, value))
        regs = registers(owner, value, len(data))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                                          pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n", "s1", "s2", "regs"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, s1, s2, regs): set size, 128-bit hash of the set and HyperMinHash registers."""
    return core.texts(docs, id_col, text_col).mapInArrow(_sketch, "doc_id long, n long, s1 long, s2 long, regs binary")


def _regs(batch, column):
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint16).reshape(-1, BUCKETS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers in which an empty bucket borrows from a bucket that its number points to, in the same order for all
    sets. So registers of small sets agree with the probability of their similarity too, not because both are empty."""
    out, own = regs.copy(), regs != EMPTY
    rows = np.flatnonzero(~own.all(1) & own.any(1))
    for turn in range(1, 1 << 16):
        if not len(rows):
            break
        place = np.full(BUCKETS, turn, np.uint64)
        target = (core.mix(place, np.arange(BUCKETS, dtype=np.uint64)) >> np.uint64(40)).astype(np.int64) % BUCKETS
        if turn > 4 * BUCKETS:  # what is still open takes the next bucket on the ring
            target = (np.arange(BUCKETS) + turn) % BUCKETS
        take = (out[rows] == EMPTY) & own[rows][:, target]
        out[rows] = np.where(take, regs[rows][:, target], out[rows])
        rows = rows[(out[rows] == EMPTY).any(1)]
    return out


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = filled(_regs(batch, "regs"))
        keys, docs, sizes = [], [], []
        doc, n = np.asarray(batch.column("doc_id")), np.asarray(batch.column("n"))
        for band in range(BANDS):
            part = regs[:, band * WIDTH:(band + 1) * WIDTH]
            used = (part != EMPTY).any(1)
            key = np.full(len(part), core.mix(np.array([band], np.uint64), np.array([_SALT]))[0])
            for j in range(WIDTH):
                key = core.mix(key, part[:, j].astype(np.uint64))
            keys.append(key[used].view(np.int64))
            docs.append(doc[used])
            sizes.append(n[used])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, docs, sizes)], names=["key", "doc_id", "n"])


def _likely(batches):
    """Pairs whose estimate is not clearly below the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        est, err = estimate(_regs(batch, "ra"), _regs(batch, "rb"), np.asarray(batch.column("na")), np.asarray(batch.column("nb")))
        at = np.flatnonzero(est >= PERCENT / 100 - ERRORS * err)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at))], names=["a", "b"])


def _close(a, b) -> str:
    """Sizes alone allow the link."""
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose sizes and estimate allow a link."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_close("na", "nb")).mapInArrow(_likely, "a long, b long")


def _confirm(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links of one hub to a block of documents, on full shingle sets."""
    hub = key[0].as_py()
    doc, data = core.ids(table), [x or b"" for x in table.column("data").to_pylist()]
    mine = [x for d, x in zip(doc, data, strict=True) if d == hub]
    found = []
    own = [shingles([x])[1] for x in mine]
    for d, x in zip(doc, data, strict=True):
        if d != hub:
            other = shingles([x])[1]
            for h in own:
                both = len(np.intersect1d(h, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(h) + len(other) - both):
                    found.append(int(d))
                    break
    return pa.table([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 85 * union; a hub's partners are dealt out in blocks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    partners = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), F.col("b").alias("_doc"))
    hubs = shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("a").alias("_doc"))
    wanted = partners.select("a", F.col("share").cast("long"), "_doc").unionByName(hubs)
    return wanted.join(rows, wanted["_doc"] == rows["doc_id"]).select("a", "share", "doc_id", "data").groupBy("a", "share").applyInArrow(_confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable over ``edges`` (a, b), by neighbours' minima and label jumps to a fixpoint."""
    both = core.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = core.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("step"), F.col("label").alias("old"))
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        nxt = core.cut(stepped.join(target, stepped["step"] == target["at"]).select("node", F.least("step", "further").alias("label"), "old"))
        moved = nxt.where("label < old").limit(1).count()
        labels = nxt.select("node", "label")
        if not moved:
            return labels


def _root(parent: dict, x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = x = parent.get(parent[x], parent[x])
    return x


def _across(table: pa.Table) -> pa.Table:
    """Links between documents of different components in two blocks of a group (or within one): the estimate first,
    then full shingle sets. Of links within what is already connected here, none more is looked for."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block, doc, comp, n = (np.asarray(table.column(c)) for c in ("block", "doc_id", "comp", "n"))
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    owner, value = shingles([x or b"" for x in table.column("data").to_pylist()])
    size = np.bincount(owner, minlength=len(doc))
    begin = np.cumsum(size) - size
    parent: dict[int, int] = {}
    first, second = [], []
    others = np.flatnonzero(block == j)
    for x in np.flatnonzero(block == i):
        roots = np.array([_root(parent, c) for c in comp[others].tolist()]) if parent else comp[others]
        other = others[(roots != _root(parent, int(comp[x]))) & (100 * np.minimum(n[others], n[x]) >= PERCENT * np.maximum(n[others], n[x]))]
        if i == j:
            other = other[doc[other] > doc[x]]
        if not len(other):
            continue
        est, err = estimate(np.broadcast_to(regs[x], (len(other), BUCKETS)), regs[other], np.full(len(other), n[x]), n[other])
        other = other[(est >= PERCENT / 100 - ERRORS * err) & (size[other] > 0)]
        if not len(other):
            continue
        own, count = value[begin[x]:begin[x] + size[x]], size[other]
        starts = np.cumsum(count) - count
        flat = value[np.repeat(begin[other] - starts, count) + np.arange(count.sum())]
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, starts)
        for y in other[100 * both >= PERCENT * (size[x] + count - both)]:
            a, b = _root(parent, int(comp[x])), _root(parent, int(comp[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                first.append(int(min(doc[x], doc[y])))
                second.append(int(max(doc[x], doc[y])))
    return pa.table([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])


def _rest(buckets: DataFrame, labels: DataFrame, reps: DataFrame, rows: DataFrame):
    """(likely pairs across components in small buckets, links found in large ones), for the buckets that the links to
    hubs left in several components. Large buckets that share documents form one group, so each pair is met once."""
    known = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("label", "doc_id")).drop("label")
    split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("doc_id").alias("least"), F.count("*").alias("size")).where("lo < hi")
    members = core.cut(known.join(split.select("key", "least", "size"), "key"))
    small = members.where(F.col("size") <= SMALL).select("key", "doc_id", "comp", "n")
    left = small.select("key", F.col("doc_id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
    right = small.select("key", F.col("doc_id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    near = left.join(right, "key").where(f"a < b AND ca <> cb AND {_close('na', 'nb')}").select("a", "b").distinct()
    large = core.cut(members.where(F.col("size") > SMALL).select("least", "doc_id", "comp", "n").distinct())
    if large.isEmpty():
        return likely(near, reps), None
    # a document names its smallest bucket head, and that head the heads of the document's other buckets
    heads = large.select("least", "doc_id").join(large.groupBy("doc_id").agg(F.min("least").alias("a")), "doc_id")
    pairs = heads.select("a", F.col("doc_id").alias("b")).unionByName(heads.select("a", F.col("least").alias("b"))).distinct()
    groups = components(pairs.where("a <> b"))
    inside = large.select("doc_id", "comp", "n").distinct().join(groups.select(F.col("node").alias("doc_id"), F.col("label").alias("grp")), "doc_id")
    counts = inside.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = (inside.join(counts, "grp").join(reps.select("doc_id", "regs"), "doc_id").join(rows, "doc_id")
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("long")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("grp", F.least("block", "x").cast("long").alias("i"), F.greatest("block", "x").cast("long").alias("j"), "block", "doc_id", "comp", "n", "regs", "data"))
    return likely(near, reps), dealt.groupBy("grp", "i", "j").applyInArrow(_across, "a long, b long")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(documents with set size and representative, confirmed links between representatives, their components)."""
    rows = core.texts(docs, id_col, text_col)
    sketch = core.cut(sketches(docs, id_col, text_col))
    reps = core.cut(sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs")))
    # the least size at which sets that differ can be linked: n / (n + 1) reaches the threshold
    linkable = reps.where(f"100 * n >= {PERCENT} * (n + 1)")
    bands = linkable.select("doc_id", "n", "regs").mapInArrow(_bands, "key long, doc_id long, n long").distinct()
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    buckets = core.cut(bands.join(hubs, "key"))
    tried = core.cut(likely(buckets.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), reps))
    found = core.cut(confirm(tried, rows))
    labels = components(found)
    near, more = _rest(buckets.where("size > 2").select("key", "doc_id", "n"), labels, reps, rows)
    near = core.cut(near.join(tried, ["a", "b"], "left_anti"))
    rest = [core.cut(x) for x in ([] if near.isEmpty() else [confirm(near, rows)]) + ([] if more is None else [more])]
    if rest:
        for x in rest:
            found = found.unionByName(x)
        labels = components(found)
    members = sketch.select("doc_id", "n", "s1", "s2").join(reps.select("n", "s1", "s2", F.col("doc_id").alias("rep")), ["n", "s1", "s2"], "left")
    return members.select("doc_id", "n", "rep"), found, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: set size, smallest doc_id of its component and whether it is the one that stays."""
    members, _, labels = links(docs, id_col, text_col)
    out = members.join(labels, members["rep"] == labels["node"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group stays, with its columns; documents without a group all stay."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
reach AS (SELECT DISTINCT a AS node, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = doc_id"""


@query("op5_near_dedup", SQL)
def op5(spark, sf_dir):
    return near_duplicates(core.read(spark, sf_dir, "documents"))
