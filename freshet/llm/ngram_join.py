"""Near-duplicate documents by Jaccard similarity of word shingles, filtered under several token orders.

A document's set is its distinct five-word shingles.  Sets link when their
Jaccard similarity is 0.8 or more.  Any two linked sets share a token among the
first ``n - ceil(0.8 n) + 1`` tokens of both under every total order of tokens,
so a pair that misses in one order is out.  The filters meet before any set is
fetched:

1. order A puts frequent tokens last and is hashed otherwise; sets that share a
   token of their A prefixes meet in that token's run.  Their rows bring bits of
   their B and C prefixes along, and a pair leaves the run only if its sizes
   allow the similarity, what follows the token in both is enough for it (were it
   their first in common: the pair's first common token lets it through), and
   the bits of both other orders meet;
2. under orders B and C, hashed differently, the sketches of the whole prefixes
   have to agree so far that no more tokens are missing than two linked sets of
   these sizes can lack;
3. what is left is verified on the whole sets.

Equal sets are one node throughout.  In the first round each set meets one
partner per run, the one with the fewest rarer tokens, so a group of copies,
however large, costs about one pair for each member.  Verifying a pair also
gives what either set lacks of the other, as bits.  In the last round every pair
of different components that passes the filters is taken; of two sets that were
compared with the same third one, these bits bound the overlap from above, so
that the outskirts of a large group are not paired with all its members.  No
link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import components, picked, row_mark, small_batches, stored, table
from freshet.llm.shingles import mix, set_portions, sort_parts

PERCENT = 80
#: A token that so many sets hold is frequent and stands at the end of order A ...
FREQUENT = 64
#: ... of which the list is broadcast; where it were longer, the bar is doubled until it isn't (8 MB).
MAX_FREQUENT = 1 << 20
#: A task reports tokens that so many of its own sets hold.
LOCAL_FREQUENT = 4
#: Tasks that the rows of a frequent token are dealt to.
SALTS = 32
#: Bits of the filter over the ids whose texts are wanted (1 MB).
FILTER_BITS = 1 << 23
#: Rows of one token from which its run is cut into parts.
RUN_ROWS = 50_000
#: Rows of runs for each task that looks for pairs; Spark sorts them to disk where they don't fit.
PART_ROWS = 500_000
#: Tokens that a task counts at a time.
COUNT_TOKENS = 1_000_000
#: Names of sets that a task remembers, so as not to emit equal sets again; beyond it starts anew and some come twice.
SEEN = 200_000
#: Longest prefix of which a row's bits tell something; those of longer ones let all through.
MASKED = 24
#: Longest run whose rows are paired along with those of other runs.
SHORT_RUN = 48
#: Bytes of what a set lacks of its reference and has beyond it: 128 bits each, and both sizes.
DELTA = 48
#: First tokens of a set's A prefix that its rows bring to the last round.
LEADS = 16
_SIGN = np.uint64((1 << 63) - 1)


def _signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Names of the sets that stand in ``tokens`` between neighbouring bounds: 63 bits that depend on all a set's tokens; 0 is the empty set's."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=np.uint64)
    some = n > 0
    if some.any():
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(tokens, 21), bounds[:-1][some]) + n[some].astype(np.uint64)
        out[some] = (mix(sums, 22) & _SIGN) | np.uint64(1)
    return out.view(np.int64)


def _prefix_length(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - -(-PERCENT * n // 100) + 1)


def _parts(tokens: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets for which ``keep`` is true, as tokens and bounds."""
    n = np.diff(bounds)
    return tokens[np.repeat(keep, n)], np.append(0, np.cumsum(n[keep]))


def _places(bounds: np.ndarray) -> np.ndarray:
    """Each token's place in its set."""
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


def _prefix_keys(tokens: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all sets' prefixes under the order of that seed, sorted, and their bounds."""
    n = np.diff(bounds)
    p = _prefix_length(n)
    keys = sort_parts(mix(tokens, seed), bounds)
    return keys[_places(bounds) < np.repeat(p, n)], np.append(0, np.cumsum(p))


def _prefixes(tokens: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order A's prefixes of sets whose tokens are sorted, as (token, place, number of the set): the order of tokens, those marked ``frequent`` last."""
    n = np.diff(bounds)
    place = _places(bounds)
    rare = np.append(0, np.cumsum(~frequent))
    before = rare[:-1] - np.repeat(rare[bounds[:-1]], n)  # rare tokens of the set ahead of this one
    place = np.where(frequent, np.repeat(rare[bounds[1:]] - rare[bounds[:-1]], n) + place - before, before)
    taken = np.flatnonzero(place < np.repeat(_prefix_length(n), n))
    return tokens[taken], place[taken], np.repeat(np.arange(len(n)), n)[taken]


def _sketches(tokens: np.ndarray, bounds: np.ndarray, seed: int) -> list[bytes]:
    """The keys of each set's prefix under the order of that seed, cut to 16 bits, sorted."""
    keys, at = _prefix_keys(tokens, bounds, seed)
    data = (keys >> np.uint64(48)).astype(np.uint16).tobytes()
    return [data[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sketch(s: np.ndarray, seed: int) -> bytes:
    return _sketches(s, np.array([0, len(s)]), seed)[0]


def _masks(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set 32 bits that the tokens of its B prefix set, and 32 of its C prefix; linked sets have bits of both in common."""
    n = np.diff(bounds)
    out = np.full(len(n), -1, dtype=np.int64)
    told = (n > 0) & (_prefix_length(n) <= MASKED)
    if told.any():
        some, at = _parts(tokens, bounds, told)
        halves = []
        for seed in (2, 3):
            keys, of = _prefix_keys(some, at, seed)
            halves.append(np.bitwise_or.reduceat(np.uint64(1) << (keys & np.uint64(31)), of[:-1]))
        out[told] = (halves[0] | halves[1] << np.uint64(32)).view(np.int64)
    return out


def _mask(s: np.ndarray) -> int:
    return int(_masks(s, np.array([0, len(s)]))[0])


class _New:
    """Names not met before in this task; beyond SEEN of them it starts anew."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), dtype=bool)
        for i, name in enumerate(names.tolist()):
            if name not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(name)
                out[i] = True
        return out


def _bits(tokens: np.ndarray) -> np.ndarray:
    """128 bits of which each token sets one."""
    at = mix(tokens, 4) & np.uint64(127)
    return np.array([np.bitwise_or.reduce(np.uint64(1) << (at[at >> np.uint64(6) == w] & np.uint64(63)), initial=np.uint64(0)) for w in (0, 1)], dtype=np.uint64)


def most_common(x: np.ndarray, n: int | np.ndarray, others: np.ndarray) -> np.ndarray:
    """The largest overlap that a set of ``n`` tokens can have with each of the others, from what they lack of one reference and have beyond it; or, with as many rows of ``x``, that each set can have with the other of its row.

    ``x`` and the rows of ``others``: bits lacked (2), bits beyond (2), tokens
    lacked, tokens beyond.  The reference's tokens that either set lacks are not
    common; of those beyond it, tokens whose bit the other has not set aren't.
    """
    ones = lambda b: np.bitwise_count(b).sum(axis=-1).astype(np.int64)
    sizes, x_sizes = others[:, 4:].astype(np.int64), x[..., 4:].astype(np.int64)
    lacked = np.maximum(ones(others[:, :2] | x[..., :2]), np.maximum(sizes[:, 0], x_sizes[..., 0]))
    beyond = np.minimum(x_sizes[..., 1] - ones(x[..., 2:4] & ~others[:, 2:4]), sizes[:, 1] - ones(others[:, 2:4] & ~x[..., 2:4]))
    return n + x_sizes[..., 0] - x_sizes[..., 1] - lacked + beyond


def may_link(bx: np.ndarray, nx: int, by: np.ndarray, ny: int) -> bool:
    """Whether two sets can link, from their sketches and sizes; never false for sets that do.

    Below the lower of the two last keys both sketches are complete.  Of a set's
    tokens there, those without an equal cut key in the other are surely missing
    from it, and linked sets lack no more than their sizes allow.
    """
    need = -(-PERCENT * (nx + ny) // (100 + PERCENT))
    end = min(int(b[-1]) if len(b) < n else 1 << 16 for b, n in ((bx, nx), (by, ny)))
    x, y = bx[: np.searchsorted(bx, end)], by[: np.searchsorted(by, end)]
    if len(x) == 0 or len(y) == 0:
        both = 0
    else:
        # equal cut keys meet as often as both sides have them
        kx, cx = np.unique(x, return_counts=True)
        at = np.searchsorted(y, kx), np.searchsorted(y, kx, side="right")
        both = int(np.minimum(cx, at[1] - at[0]).sum())
    return len(x) - both <= nx - need and len(y) - both <= ny - need


def _batch(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows again, cut so that rows with equal keys stand in one batch; no more than a batch and its last run are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if len(starts):
            cut = int(starts[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
            continue
        if held and any(held[0].column(k)[0].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def classes(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, mark, key, sig, n_shingles, b, c) for every row of ``docs(doc_id, text, mark, key)``, and the frequent tokens, sorted; b and c, the sketches, stand at a set's first row in a task.

    One pass over the texts; the tokens of equal sets count once in a task.
    Tasks only report what is frequent among their own sets, so a token spread
    thinly over very many tasks can be missed; the list only orders tokens, and
    the run of a missed one is streamed and cut like any other.
    """
    schema = [("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("token", pa.int64()), ("b", pa.binary()), ("c", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_names = _New()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            all_tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            all_tokens.sort()
            k = LOCAL_FREQUENT - 1
            token = np.unique(all_tokens[k:][all_tokens[k:] == all_tokens[: len(all_tokens) - k]]) if len(all_tokens) > k else all_tokens[:0]
            n = np.searchsorted(all_tokens, token, side="right") - np.searchsorted(all_tokens, token)
            none = [None] * len(token)
            return _batch(schema, none, none, none, none, n, token.view(np.int64), none, none)

        for batch in batches:
            sigs, sizes, bs, cs = [], [], [], []
            for tokens, bounds in set_portions(batch.column(1)):
                names = _signatures(tokens, bounds)
                sigs += names.tolist()
                sizes += np.diff(bounds).tolist()
                new = new_names(names) & (names != 0)
                tokens, bounds = _parts(tokens, bounds, new)
                for column, seed in ((bs, 2), (cs, 3)):
                    made = iter(_sketches(tokens, bounds, seed))
                    column += [next(made) if x else None for x in new]
                held.append(tokens)
                size += len(tokens)
                if size >= COUNT_TOKENS:
                    yield frequent()
                    size = 0
            yield _batch(schema, batch.column(0), batch.column(2), batch.column(3), sigs, sizes, [None] * len(sigs), bs, cs)
        yield frequent()

    both = stored(docs.select("doc_id", "text", "mark", "key").mapInArrow(run, "doc_id long, mark long, key long, sig long, n long, token long, b binary, c binary"))
    counts = stored(both.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT))
    bar = FREQUENT
    while counts.where(F.col("n") >= bar).count() > MAX_FREQUENT:
        bar *= 2
    tokens = counts.where(F.col("n") >= bar).select("token").toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64)
    return both.where("token is null").select("doc_id", "mark", "key", "sig", F.col("n").alias("n_shingles"), "b", "c"), np.sort(tokens)


def shared_tokens(docs: DataFrame, frequent: np.ndarray, text: str) -> DataFrame:
    """(token, sig, place, mask) for prefix tokens under order A that at least two sets of compatible sizes share.

    place is the set's size (upper half) and the token's place in the set.
    Tasks emit a set once; after the exchange by token Spark sorts the rows, to
    disk where they don't fit, and Python streams over them and keeps the runs,
    with one row in hand however long a run is.  A frequent token's rows are
    dealt to SALTS tasks by the set's name, and all of them stay.
    """
    spark = docs.sparkSession
    last = spark.sparkContext.broadcast(frequent)
    out = [("token", pa.int64()), ("sig", pa.int64()), ("place", pa.int64()), ("mask", pa.int64())]
    low = np.uint64((1 << 20) - 1)

    def frequent_test() -> Callable[[np.ndarray], np.ndarray]:
        of_low_bits = np.zeros(int(low) + 1, dtype=bool)  # most tokens need no search
        of_low_bits[last.value & low] = True

        def is_frequent(token: np.ndarray) -> np.ndarray:
            t = token.view(np.uint64)
            out = of_low_bits[t & low]
            some = t[out]
            if len(some):
                out[out] = last.value[np.minimum(np.searchsorted(last.value, some), len(last.value) - 1)] == some
            return out

        return is_frequent

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_frequent, new_names = frequent_test(), _New()
        for b in batches:
            for tokens, bounds in set_portions(b.column(0)):
                sigs = _signatures(tokens, bounds)
                new = new_names(sigs) & (sigs != 0)
                sigs, (tokens, bounds) = sigs[new], _parts(tokens, bounds, new)
                often = is_frequent(tokens)
                token, pos, of = _prefixes(tokens, bounds, often)
                n, mask, sig = np.diff(bounds)[of], _masks(tokens, bounds)[of], sigs[of]
                token = token.view(np.int64)
                yield _batch([*out, ("salt", pa.int64())], token, sig, (n << 32) | pos, mask, np.where(is_frequent(token), sig % SALTS, 0))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, is_frequent = [c for c, _ in out], frequent_test()
        waiting, fitted = None, False  # the last row, and whether it fits the one before it
        for batch in batches:
            batch = batch.select(names)
            batch = pa.concat_batches([waiting, batch]) if waiting is not None else batch
            if not batch.num_rows:
                continue
            token, sig, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy() >> 32
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])  # equal sets of other tasks
            token, n, rows = token[first], n[first], batch.filter(pa.array(first))
            fits = (token[1:] == token[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])  # in order of size the nearest sizes are neighbours
            keep = np.concatenate([[fitted], fits]) | np.concatenate([fits, [False]]) | is_frequent(token)
            waiting, fitted = rows.slice(len(token) - 1), bool(fits[-1]) if len(fits) else fitted
            keep[-1] = False
            yield rows.filter(pa.array(keep))
        if waiting is not None and (fitted or is_frequent(waiting.column(0).to_numpy())[0]):
            yield waiting

    rows = docs.select(text).mapInArrow(prefixes, "token long, sig long, place long, mask long, salt long")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    dealt = rows.repartition(n_parts, "token", "salt").sortWithinPartitions("token", F.shiftright("place", 32), "sig")
    shared = stored(dealt.mapInArrow(runs, "token long, sig long, place long, mask long"))
    last.destroy()  # the table is written, nothing reads the list again
    return shared


def token_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(sig, tokens) of the sets that ``wanted(key, sig)`` names, each once, tokens sorted.

    A bit filter of fixed size over the wanted keys thins the texts as they are
    read; beyond its size it lets more through, never less, and the join with
    ``wanted`` decides.  One Python worker a task filters and cuts the texts.
    """
    spark = docs.sparkSession
    schema = [("key", pa.int64()), ("sig", pa.int64()), ("tokens", pa.binary())]
    marks = wanted.select(F.pmod("key", F.lit(FILTER_BITS)).alias("m")).distinct()
    words = marks.groupBy(F.floor(F.col("m") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 64 as int))")).alias("v")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64)
    mask = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_keys = _New()
        for batch in batches:
            m = batch.column(2).to_numpy()
            hit = (mask.value[m // 64].view(np.uint64) >> (m % 64).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            keys, at = batch.column(0).to_numpy(), 0
            for tokens, bounds in set_portions(batch.column(1)):
                own = keys[at : at + len(bounds) - 1]
                at += len(own)
                new = new_keys(own)  # else a repeated row
                sigs, data = _signatures(tokens, bounds), tokens.tobytes()
                sets = [data[8 * bounds[i] : 8 * bounds[i + 1]] for i in np.flatnonzero(new)]
                for a in range(0, len(sets), 1_000):
                    yield _batch(schema, own[new][a : a + 1_000], sigs[new][a : a + 1_000], sets[a : a + 1_000])

    marked = docs.select("key", text, F.pmod("key", F.lit(FILTER_BITS)).alias("m"))
    met = marked.mapInArrow(run, "key long, sig long, tokens binary").join(wanted, ["key", "sig"])
    sets = stored(met.dropDuplicates(["key", "sig"]).select("sig", "tokens"))  # repeated rows stand in many tasks
    mask.destroy()
    return sets


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, text: str, sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of the pairs (x, y) those that both sketches let through: linked, and what either set lacks of the other; and all sets fetched so far.

    ``first(sig, key, n, b, c)`` has a row per set; ``sets`` are those of the
    rounds before, whose texts are not read again.
    """

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = list(zip(batch.column("x_n").to_pylist(), batch.column("y_n").to_pylist(), strict=True))
            keep = np.ones(batch.num_rows, dtype=bool)
            for order in "bc":
                xb, yb = batch.column(f"x_{order}"), batch.column(f"y_{order}")
                for i in np.flatnonzero(keep):
                    n, m = sizes[i]
                    keep[i] = may_link(np.frombuffer(xb[i].as_buffer(), np.uint16), n, np.frombuffer(yb[i].as_buffer(), np.uint16), m)
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    schema = [("x", pa.int64()), ("y", pa.int64()), ("linked", pa.bool_()), ("x_delta", pa.binary()), ("y_delta", pa.binary())]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, deltas = [], ([], [])
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x_tokens", "y_tokens"))
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = b[at] == a
                other = np.ones(len(b), dtype=bool)
                other[at[common]] = False
                only = a[~common], b[other]
                bits, sizes = [_bits(t) for t in only], [len(t) for t in only]
                for side, lacked, beyond in ((0, 1, 0), (1, 0, 1)):
                    deltas[side].append(np.concatenate([bits[lacked], bits[beyond], np.array([sizes[lacked], sizes[beyond]], dtype=np.uint64)]).tobytes())
                both = int(common.sum())
                linked.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield _batch(schema, batch.column("x"), batch.column("y"), linked, *deltas)

    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("sig").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    near = pairs.join(side(first, "x", "b", "c", "n"), "x").join(side(first, "y", "b", "c", "n"), "y").select("x", "y", "x_b", "y_b", "x_c", "y_c", "x_n", "y_n")
    left = stored(near.mapInArrow(meets, "x long, y long"))
    ends = left.select(F.col("x").alias("sig")).unionByName(left.select(F.col("y").alias("sig"))).distinct()
    wanted = ends.join(first.select("sig", "key"), "sig")
    wanted = stored(wanted if sets is None else wanted.join(sets.select("sig"), "sig", "left_anti"))
    if sets is None or not wanted.isEmpty():
        new = token_sets(docs, wanted, text)
        sets = new if sets is None else sets.unionByName(new)
    whole = left.join(side(sets, "x", "tokens"), "x").join(side(sets, "y", "tokens"), "y").select("x", "y", "x_tokens", "y_tokens")
    return stored(whole.mapInArrow(compared, "x long, y long, linked boolean, x_delta binary, y_delta binary")), sets


def deltas(compared: DataFrame) -> DataFrame:
    """(sig, ref, delta) for each set of a compared pair: of its partners the one that was compared most often, and how the set differs from it."""
    both = compared.select(F.col("x").alias("sig"), F.col("y").alias("ref"), F.col("x_delta").alias("delta")).unionByName(compared.select(F.col("y").alias("sig"), F.col("x").alias("ref"), F.col("y_delta").alias("delta")))
    popular = both.groupBy("ref").agg(F.count("*").alias("_met"))
    return both.join(popular, "ref").groupBy("sig").agg(F.max_by(F.struct("ref", "delta"), F.struct("_met", "ref")).alias("_d")).select("sig", "_d.ref", "_d.delta")


def candidates(rows: DataFrame, every: bool, seed: int) -> DataFrame:
    """Candidate pairs (x, y) from ``rows(token, sig, place, mask, comp, ref, delta)``: sets of different components that share a token.

    ``every`` takes rows with ``leads`` too, the set's first LEADS tokens under
    order A: a pair that has one of them in common before this token leaves in
    that token's run and not again here, in however many runs both sets stand.

    All filters that a row knows of apply before a pair leaves the run: sizes,
    bits of the B and C prefixes, and what stands from the token on in the
    shorter rest, which has to reach the overlap that the sizes ask for if this
    token is the pair's first in common.  ``every``: all pairs that pass, those
    compared with the same reference only if what they differ by allows it.
    Otherwise each set meets one other of its run: the run's pivot, before which
    the fewest rarer tokens stand, and the pivot's component meets the next of
    the others.

    A run of more than RUN_ROWS rows is cut into k parts by the sets' names.
    Where a set meets one other, parts stand alone; for every pair, a task gets
    two of the parts and pairs one with the other.  Spark sorts the rows, and
    Python holds one run (two parts of it at most) at a time.
    """
    schema = [("x", pa.int64()), ("y", pa.int64())]
    columns = ("token", "sig", "place", "mask", "comp", "ref", "i", "j", "part", *(["delta", "leads"] if every else []))
    plain = columns.index("part") + 1

    def passing(n: np.ndarray, rest: np.ndarray, mask: np.ndarray, m: np.ndarray | int, other_rest: np.ndarray | int, other_mask: np.ndarray | int) -> np.ndarray:
        need = -(-PERCENT * (n + m) // (100 + PERCENT))
        both = mask & other_mask
        return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (np.minimum(rest, other_rest) >= need) & (both & 0xFFFFFFFF != 0) & (both >> 32 != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []
        held = 0
        for batch in _whole_runs(batches, tuple(columns.index(c) for c in ("token", "i", "j"))):
            held += met_in(batch, xs, ys)
            if held >= 1 << 20:
                yield distinct(xs, ys)
                xs, ys, held = [], [], 0
        yield distinct(xs, ys)

    def met_in(batch: pa.RecordBatch, xs: list[np.ndarray], ys: list[np.ndarray]) -> int:
        """Adds the pairs of whole runs to ``xs`` and ``ys`` and says how many they are."""
        token, sig, place, mask, comp, ref, i, j, part = (batch.column(c).to_numpy() for c in range(plain))
        delta, leads = (_fixed(batch.column(c)) for c in range(plain, len(columns))) if every else (None, None)
        n, pos = place >> 32, place & 0xFFFFFFFF
        new = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(np.concatenate([[True], new]))
        rest = n - pos
        if not every:
            x, y = partners(np.append(0, np.cumsum(new)), starts, sig, comp, rest)
            ok = passing(n[x], rest[x], mask[x], n[y], rest[y], mask[y])
            xs.append(sig[x[ok]])
            ys.append(sig[y[ok]])
            return int(ok.sum())
        ends = np.append(starts[1:], len(token))
        held = 0

        def bounded(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of pairs of rows those that no earlier token and no reference rule out."""
            if len(x):
                same = np.flatnonzero((ref[x] == ref[y]) & (ref[x] != 0))
                need = -(-PERCENT * (n[x[same]] + n[y[same]]) // (100 + PERCENT))
                ok = np.ones(len(x), dtype=bool)
                ok[same] = most_common(delta[x[same]], n[x[same]], delta[y[same]]) >= need
                x, y = x[ok], y[ok]
            if len(x):
                met = np.zeros(len(x), dtype=bool)
                for c in range(LEADS):  # a token that both have ahead of this one
                    lead = np.where(c < pos[x], leads[x, c], 0)
                    met |= (lead != 0) & (leads[y] == lead[:, None]).any(axis=1)
                x, y = x[~met], y[~met]
            return x, y

        # short runs, all at once: each row meets that d places on, as long as the sizes of a run's rows allow it
        run_end = np.repeat(ends, ends - starts)
        short = np.repeat(ends - starts <= SHORT_RUN, ends - starts)
        x = np.flatnonzero(short)
        for d in range(1, SHORT_RUN):
            x = x[x + d < run_end[x]]
            x = x[100 * n[x] >= PERCENT * n[x + d]]
            if not len(x):
                break
            p = x[(comp[x] != comp[x + d]) & ((i[x] == j[x]) | (part[x] != part[x + d]))]
            p = p[passing(n[p], rest[p], mask[p], n[p + d], rest[p + d], mask[p + d])]
            p, q = bounded(p, p + d)
            xs.append(sig[p])
            ys.append(sig[q])
            held += len(p)
        long = ends - starts > SHORT_RUN
        for a, z in zip(starts[long], ends[long], strict=True):
            m, k, bits = n[a:z], comp[a:z], mask[a:z]
            names, at, counts = np.unique(k, return_inverse=True, return_counts=True)
            large = at == counts.argmax()  # the others meet it and one another
            for r in np.flatnonzero(~large):
                lo, hi = np.searchsorted(m, -(-PERCENT * m[r] // 100)), np.searchsorted(m, 100 * m[r] // PERCENT, side="right")
                met = np.arange(lo, hi)
                met = met[(k[met] != k[r]) & (large[met] | (met > r))]
                met = met[passing(m[met], rest[a + met], bits[met], m[r], rest[a + r], bits[r])]
                if i[a] != j[a]:
                    met = met[part[a + met] != part[a + r]]
                x, y = bounded(np.full(len(met), a + r), a + met)
                xs.append(sig[x])
                ys.append(sig[y])
                held += len(x)
        return held

    def partners(run: np.ndarray, starts: np.ndarray, sig: np.ndarray, comp: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and whom they meet in their runs: the pivot, or if they are of its component, the first of another one."""
        order = np.lexsort((mix(sig.view(np.uint64), seed), -rest, run))
        pivot = order[starts][run]
        other = np.flatnonzero(comp[order] != comp[pivot])  # in order, and runs stand where they stood
        of_run, first = np.unique(run[other], return_index=True)
        second = np.full(len(starts), -1)
        second[of_run] = order[other[first]]
        partner = np.where(comp == comp[pivot], second[run], pivot)
        x = np.flatnonzero(partner >= 0)
        return x, partner[x]

    def distinct(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.RecordBatch:
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (xs, ys))
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return _batch(schema, pair[:, 0], pair[:, 1])

    large = stored(rows.groupBy("token").agg(F.count("*").alias("_rows")).where(F.col("_rows") > RUN_ROWS).withColumn("_k", F.ceil(F.col("_rows") / RUN_ROWS)))
    n_rows = rows.count() + (large.agg(F.coalesce(F.sum(F.col("_rows") * F.col("_k")), F.lit(0))).first()[0] if every else 0)
    dealt = rows.join(large.select("token", "_k"), "token", "left")
    dealt = dealt.withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("part", F.pmod("sig", F.col("_k")))
    if every:
        dealt = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        dealt = dealt.withColumns({"i": F.least("part", "_t"), "j": F.greatest("part", "_t")})
    else:
        dealt = dealt.withColumns({"i": F.col("part"), "j": F.col("part")})
    n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PART_ROWS))
    runs = dealt.select(*columns).repartition(n_parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", F.shiftright("place", 32), "sig")
    return runs.mapInArrow(run, "x long, y long").distinct()


def _fixed(column: pa.Array) -> np.ndarray:
    """A column of arrays of LEADS numbers, or of binaries of DELTA bytes, as rows of 64-bit numbers."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(-1, LEADS)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, DELTA // 8)


def first_tokens(shared: DataFrame) -> DataFrame:
    """(sig, leads): the tokens at the first LEADS places of a set under order A, as far as other sets share them; 0 elsewhere."""
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    tokens = [F.coalesce(F.max(F.when(at == k, F.col("token"))), F.lit(0).cast("long")) for k in range(LEADS)]
    return shared.where(at < LEADS).groupBy("sig").agg(F.array(*tokens).alias("leads"))


def grouped(docs: DataFrame, sampled_rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, sig, n_shingles) for every row of ``docs(doc_id, text, mark)``, and (sig, comp, component_id) for every set.

    comp names the component, also of sets that no row with a doc_id has.
    """
    small_batches(docs.sparkSession)
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # one row of a set's is read again, whatever ids it has
    rows, frequent = classes(docs)
    first = stored(rows.where("sig <> 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.max("b").alias("b"), F.max("c").alias("c")))
    shared = shared_tokens(docs, frequent, "text")
    found = comps = tested = sets = None
    none = F.lit(bytes(DELTA))
    for k in range(sampled_rounds + 1):
        if comps is None:
            now = shared.withColumns({"comp": F.col("sig"), "ref": F.lit(0).cast("long"), "delta": none, "leads": F.array(*[F.lit(0).cast("long")] * LEADS)})
        else:
            named = shared.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")
            mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
            now = named.join(mixed, "token", "left_semi").join(deltas(found), "sig", "left")
            now = now.withColumns({"ref": F.coalesce("ref", F.lit(0).cast("long")), "delta": F.coalesce("delta", none)})
            if k == sampled_rounds:
                no_leads = F.array(*[F.lit(0).cast("long")] * LEADS)
                now = now.join(first_tokens(shared), "sig", "left").withColumn("leads", F.coalesce("leads", no_leads))
            now = stored(now)
        pairs = candidates(now, k == sampled_rounds, 31 + k)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        new, sets = verified(pairs, first, docs, "text", sets)
        found = new if found is None else found.unionByName(new)
        comps = stored(components(found.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    named = first.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "mark", "sig", "n_shingles"), stored(named.join(least, "comp").select("sig", "comp", "component_id"))


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sampled_rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, its own included.
    A text of fewer than five words is one shingle of all of them; null, empty
    and blank texts have an empty set and link with nothing.  Repeated rows are
    linked like any equal texts and stay.  Rows without doc_id are linked like
    others; a component of such rows only has none.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("mark"))
    rows, of_sig = grouped(named, sampled_rounds)
    met = rows.join(of_sig.select(F.col("sig").alias("_sig"), "component_id"), F.col("sig") == F.col("_sig"), "left")
    own = F.when(F.col("sig") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return met.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked documents, with the columns it came with.

    It is the one with the smallest doc_id, rows without one last; of rows with
    one doc_id the one whose columns hash smallest, so reruns keep the same.
    Texts without words link with nothing, so all their rows stay.
    """
    blank = F.col(text).isNull() | ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    worded = docs.where(~blank)
    rows, of_sig = grouped(worded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), row_mark(worded).alias("mark")))
    met = rows.join(of_sig.select("sig", "comp"), "sig")
    name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    best = met.groupBy("comp").agg(F.min(name).alias("best"))
    counts = met.groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    chosen = best.select(F.col("best.doc_id").alias("id"), F.col("best.mark").alias("mark"))
    again = counts.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "rows")
    chosen = chosen.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("id", "mark", "rows")
    return picked(worded, stored(chosen), id_col).unionByName(docs.where(blank))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))
