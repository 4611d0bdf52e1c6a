"""SentencePiece encoding and decoding with seeded merge-dropout.

A merge-type (BPE) model is read for its pieces and scores alone; encoding is
done here.  A text becomes units that no piece crosses (white space with the
word after it, line ends apart).  In each unit an agenda holds the adjacent
pairs whose union is a piece, best score first, leftmost first among equals.
A pair that is taken from the agenda is skipped where a keyed hash of (seed,
document, unit number, pair, place) falls under the dropout rate, and then stays
skipped until one of its sides changes: every occurrence of a word has draws of
its own.  The distinct units of a batch are first cut without dropout, and their
merges kept; an occurrence none of whose draws at those merges is under the rate
is cut just so, and shares that result.  All others are cut one for one.  The
agendas of all units of a batch run side by side in arrays; units over ``WIDE``
code points run one by one.

Every choice of merges decodes to the text: characters without a piece, and a
literal U+2581, are written as byte pieces.

Nulls and edge cases: a null text has no ids and decodes to the empty text; so
does an empty one.  Rows that repeat are cut alike (the key is the doc_id).
"""

from __future__ import annotations

import heapq
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, resident

WIDE = 32
SPACE = "▁"
_UNIT = re.compile(r" *[^ \n]+| *\n| +")
_M1, _M2, _M3 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class MergeModel:
    """Pieces of a SentencePiece model of merge type, as tables of pairs."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {self.text[i]: i for i in range(n) if plain[i]}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [self.text[i].replace(SPACE, " ").encode() if plain[i] else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        self.pairs, self.size = pairs, n
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.array([order[sp.get_score(i)] if plain[i] else len(scores) for i in range(n)], dtype=np.int64)
        self.ranks = self.rank.tolist()
        self.worst = len(scores) + 1
        self.char = np.full(0x110000, -1, dtype=np.int64)  # code point to id; -1: bytes
        for piece, i in ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.char[ord(piece)] = i
        self.char[ord(" ")] = ids.get(SPACE, -1)
        # an open-addressed table of the pairs: one gather finds most
        self.bits = max(17, (4 * len(pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        self.probes = 1
        for k, v in pairs.items():
            at, probe = (k * _M3 & _MASK) >> (64 - self.bits), 1
            while self.slots[at] >= 0:
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            self.slots[at], self.values[at] = k, v
            self.probes = max(self.probes, probe)

    def find(self, left, right):
        """Ids of the pieces that the pairs make, -1 for none."""
        import numpy as np

        fine = (left >= 0) & (right >= 0)
        out = np.full(left.shape, -1, dtype=np.int64)
        key = (left * self.size + right)[fine]
        if not len(key):
            return out
        at = ((key.astype(np.uint64) * np.uint64(_M3)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = np.where(self.slots[at] == key, self.values[at], -1)
        open_ = np.flatnonzero((got < 0) & (self.slots[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.slots[at[open_]] == key[open_]
            got[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (self.slots[at[open_]] >= 0)]
        out[fine] = got
        return out


def _draw(key: int, left: int, right: int, place: int) -> int:
    """A keyed hash of a pair (32 bits): of the ids and of the code point where the right side starts."""
    x = (key ^ (left * _M3) ^ (right * _M1) ^ (place * _M2)) & _MASK
    x = ((x ^ (x >> 31)) * _M1) & _MASK
    x = ((x ^ (x >> 29)) * _M2) & _MASK
    return x >> 32


def _draws(key, left, right, place):
    import numpy as np

    u = np.uint64
    x = key ^ (left.astype(u) * u(_M3)) ^ (right.astype(u) * u(_M1)) ^ (place.astype(u) * u(_M2))
    x = (x ^ (x >> u(31))) * u(_M1)
    x = (x ^ (x >> u(29))) * u(_M2)
    return x >> u(32)


def agenda(model: MergeModel, ids: list[int], key: int, limit: int, trace: list | None = None) -> list[int]:
    """Merges one unit with a heap; pairs whose draw is under limit are skipped.  ids below 0 never merge.  trace gets (left, right, place) of each merge."""
    n = len(ids)
    ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def add(a: int, b: int) -> None:
        if ids[a] >= 0 and ids[b] >= 0:
            made = model.pairs.get(ids[a] * model.size + ids[b])
            if made is not None:
                heapq.heappush(heap, (model.ranks[made], a, b, ids[a], ids[b]))

    for i in range(n - 1):
        add(i, i + 1)
    while heap:
        _, a, b, x, y = heapq.heappop(heap)
        if not (alive[a] and alive[b] and ids[a] == x and ids[b] == y and right[a] == b):
            continue
        if limit and _draw(key, x, y, b) < limit:
            continue
        if trace is not None:
            trace.append((x, y, b))
        ids[a], alive[b], right[a] = model.pairs[x * model.size + y], False, right[b]
        if right[a] < n:
            left[right[a]] = a
            add(a, right[a])
        if left[a] >= 0:
            add(left[a], a)
    return [x for x, live in zip(ids, alive, strict=True) if live]


def _agendas(model: MergeModel, ids, key, limit: int, trace: list | None = None):
    """The agendas of units of equal width side by side: ids (units x width, -9 past the end); returns ids, -9 for what is merged away.

    trace gets arrays (unit, left, right, place) of the merges.
    """
    import numpy as np

    n, width = ids.shape
    ids = ids.copy()
    if width < 2:
        return ids
    column = np.arange(width)
    nxt = np.where(np.roll(ids, -1, axis=1) == -9, width, column + 1)  # where the right neighbour starts
    nxt[:, -1] = width
    prv = np.broadcast_to(column - 1, ids.shape).copy()
    made = np.full(ids.shape, -1, dtype=np.int64)
    made[:, :-1] = model.find(ids[:, :-1], ids[:, 1:])
    # the agenda's order as one number: rank of the piece, then place
    order = np.where(made >= 0, model.rank[made] * width + column, model.worst * width)
    live = np.arange(n)
    while len(live):
        a = order[live].argmin(axis=1)
        some = order[live, a] < model.worst * width
        live, a = live[some], a[some]
        if not len(live):
            break
        b = nxt[live, a]
        skip = np.zeros(len(live), dtype=bool)
        if limit:
            skip = _draws(key[live], ids[live, a], ids[live, b], b) < np.uint64(limit)
            order[live[skip], a[skip]] = model.worst * width
        r, a, b = live[~skip], a[~skip], b[~skip]
        if trace is not None:
            trace.append((r, ids[r, a], ids[r, b], b))
        ids[r, a] = made[r, a]
        ids[r, b] = -9
        order[r, b] = model.worst * width
        c = nxt[r, b]
        nxt[r, a] = c
        inside = c < width
        prv[r[inside], c[inside]] = a[inside]
        right = np.where(inside, ids[r, np.minimum(c, width - 1)], -1)
        made[r, a] = model.find(ids[r, a], right)
        order[r, a] = np.where(made[r, a] >= 0, model.rank[made[r, a]] * width + a, model.worst * width)
        p = prv[r, a]
        back = p >= 0
        r, a, p = r[back], a[back], p[back]
        made[r, p] = model.find(ids[r, p], ids[r, a])
        order[r, p] = np.where(made[r, p] >= 0, model.rank[made[r, p]] * width + p, model.worst * width)
    return ids


def _expand(model: MergeModel, ids: list[int], unit: str) -> list[int]:
    """Puts byte pieces for the symbols that have no piece (below 0: -10 - place in the unit)."""
    out = []
    for x in ids:
        if x >= 0:
            out.append(x)
        else:
            out.extend(model.byte[b] for b in unit[-10 - x].encode("utf-8", "surrogatepass"))
    return out


def encode_units(model: MergeModel, units: list[str], keys, rate: float, trace: list | None = None):
    """(flat ids, lengths) of units, each cut under its key (unsigned 64 bits).  trace gets arrays (unit, left, right, place) of the merges."""
    import numpy as np

    limit = int(rate * (1 << 32))
    size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    first = np.cumsum(size) - size
    ids = model.char[points]
    place = np.arange(len(points)) - np.repeat(first, size)
    ids = np.where(ids >= 0, ids, -10 - place)
    out: list = [None] * len(units)
    lengths = np.zeros(len(units), dtype=np.int64)
    low = 0
    for width in (2, 4, 6, 8, 10, 12, 16, 24, WIDE):
        at = np.flatnonzero((size > low) & (size <= width))
        low = width
        if not len(at):
            continue
        grid = np.full((len(at), width), -9, dtype=np.int64)
        column = np.arange(width)
        inside = column[None, :] < size[at][:, None]
        grid[inside] = ids[(first[at][:, None] + column)[inside]]
        merges = None if trace is None else []
        done = _agendas(model, grid, keys[at], limit, merges)
        if merges:
            trace += [(at[r], x, y, b) for r, x, y, b in merges]
        kept = done != -9
        odd = np.flatnonzero((done <= -10).any(axis=1))
        lengths[at] = kept.sum(axis=1)
        rows = np.split(done[kept], np.cumsum(lengths[at])[:-1])
        for i, row in zip(at.tolist(), rows, strict=True):
            out[i] = row
        for j in odd.tolist():
            i = int(at[j])
            out[i] = np.array(_expand(model, out[i].tolist(), units[i]), dtype=np.int64)
            lengths[i] = len(out[i])
    for i in np.flatnonzero(size > WIDE).tolist():
        merges = None if trace is None else []
        got = agenda(model, ids[first[i] : first[i] + size[i]].tolist(), int(keys[i]), limit, merges)
        if merges:
            trace.append((np.full(len(merges), i), *np.array(merges, dtype=np.int64).T))
        out[i] = np.array(_expand(model, got, units[i]), dtype=np.int64)
        lengths[i] = len(out[i])
    for i in np.flatnonzero(size == 0).tolist():
        out[i] = np.empty(0, dtype=np.int64)
    return (np.concatenate(out) if out else np.empty(0, dtype=np.int64)), lengths


def _mix(x):
    import numpy as np

    u = np.uint64
    x = (x ^ (x >> u(30))) * u(_M1)
    x = (x ^ (x >> u(27))) * u(_M2)
    return x ^ (x >> u(31))


def _drawn(trace: list, code, keys, limit: int):
    """Which occurrences (unit code, key) have a draw under limit at a merge of their unit."""
    import numpy as np

    out = np.zeros(len(code), dtype=bool)
    if not trace or not limit:
        return out
    unit, left, right, place = map(np.concatenate, zip(*trace, strict=True))
    by = np.argsort(unit, kind="stable")
    left, right, place = left[by], right[by], place[by]
    n = np.bincount(unit, minlength=int(code.max()) + 1)
    first = np.cumsum(n) - n
    total = np.cumsum(n[code])
    lo = 0
    while lo < len(code):  # some 2^20 draws at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20))))
        part, size = code[lo:hi], n[code[lo:hi]]
        owner = np.repeat(np.arange(lo, hi), size)
        at = np.arange(len(owner)) + np.repeat(first[part] - (np.cumsum(size) - size), size)
        out[owner[_draws(keys[owner], left[at], right[at], place[at]) < np.uint64(limit)]] = True
        lo = hi
    return out


def unit_keys(doc_keys, counts, seed: int):
    """A key for each unit of documents with so many units: of the seed, the document and the unit's number."""
    import numpy as np

    u = np.uint64
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    base = _mix(np.asarray(doc_keys, dtype=np.int64).astype(u) + u(seed * _M3 & _MASK))
    return _mix(np.repeat(base, counts) + number.astype(u) * u(_M3))


def encode_batch(model: MergeModel, texts: list[str], doc_keys, seed: int, rate: float):
    """A list of id arrays for whole texts."""
    import numpy as np
    import pandas as pd

    units, counts = [], []
    for text in texts:
        found = _UNIT.findall(" " + text) if text else []
        units += found
        counts.append(len(found))
    if not units:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    counts = np.array(counts)
    joint, distinct = pd.factorize(np.array(units, dtype=object))
    trace: list | None = [] if rate else None
    flat, lengths = encode_units(model, distinct.tolist(), np.zeros(len(distinct), dtype=np.uint64), 0.0, trace)
    if rate:
        keys = unit_keys(doc_keys, counts, seed)
        own = np.flatnonzero(_drawn(trace, joint, keys, int(rate * (1 << 32))))
        more, sizes = encode_units(model, [units[i] for i in own.tolist()], keys[own], rate)
        joint[own] = len(distinct) + np.arange(len(own))
        flat, lengths = np.concatenate((flat, more)), np.concatenate((lengths, sizes))
    start = np.cumsum(lengths) - lengths
    size = lengths[joint]
    total = np.cumsum(size)
    take = np.arange(total[-1]) - np.repeat(total - size, size) + np.repeat(start[joint], size)
    ids = flat[take]
    ends = np.concatenate(([0], total))[np.cumsum(counts)]
    return np.split(ids, ends[:-1])


def decode(model: MergeModel, ids) -> str:
    """The text of ids: pieces' bytes joined, the space that encoding puts in front taken off."""
    data = b"".join(map(model.bytes.__getitem__, ids.tolist()))
    return data[1:].decode("utf-8", "surrogatepass") if data else ""


def merge_model(name: str = "piece_bpe_32k.model") -> MergeModel:
    import public_tokenizers

    return resident(f"pieces {name}", lambda: MergeModel(public_tokenizers.path(name)))


def _encode(name: str, seed: int, rate: float, keep_ids: bool):
    def run(batches):
        import numpy as np
        import pandas as pd

        model = merge_model(name)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            coded = encode_batch(model, texts, batch["key"].to_numpy(dtype=np.int64), seed, rate)
            out = {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) for x in coded],
                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in coded],
                "lossless": [decode(model, x) == t for x, t in zip(coded, texts, strict=True)],
            }
            if keep_ids:
                out["ids"] = [x.astype(np.int32) for x in coded]
            yield pd.DataFrame(out)

    return run


def encode(docs: DataFrame, seed: int = 1, rate: float = 0.1, model: str = "piece_bpe_32k.model", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless (and ids) of docs(doc_id, text)."""
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("key"))
    schema = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * keep_ids
    return map_slices(keyed, _encode(model, seed, rate, keep_ids), schema)


def decode_ids(coded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text of rows with ids."""

    def run(batches):
        import numpy as np
        import pandas as pd

        m = merge_model(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [decode(m, np.asarray(x)) for x in batch["ids"]]})

    return map_slices(coded.select("doc_id", "ids"), run, "doc_id long, text string")
