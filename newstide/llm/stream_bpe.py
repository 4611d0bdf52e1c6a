"""Byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list in which every part of a merge is made by earlier merges is applied
in the order of its ranks, so what stands right of a place reaches to the left
of it only by a chain of later and later merges.  :func:`lookahead` follows all
chains at once, from the last merge to the first, and gives the bytes that the
longest one crosses (129 for the public 50k list).  A token that ends so many
bytes before the end of what has been read is therefore a token of the whole
text, whatever comes: the :class:`Transducer` emits it and forgets its bytes,
so it holds one window at most, however long a unit is.

Text comes in chunks (:class:`Encoder`): strings of added tokens are cut out,
units are split by the pre-tokenizer's classes, a unit that no chunk ends is
passed on as it comes, and short units go through the transducer once for each
worker.  :class:`Decoder` turns ids back to text as they come; its state is the
bytes of an unfinished code point (three at most).

Nulls and edge cases: a null text is an empty one and has no ids; code points
are classed as the tokenizer's library does (newer Unicode versions class some
otherwise); bytes that are no UTF-8 decode to U+FFFD, one for each longest
beginning of a code point; unknown ids and nulls among ids decode to nothing; rows that repeat are
encoded alike; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_slices, resident

#: Code points that the encoder takes from a text at a time, bytes over the lookahead that the transducer gathers, units that a worker keeps.
CHUNK, WINDOW, KEPT_UNITS = 1 << 16, 1 << 12, 1 << 18
#: Characters from which a unit at the end of a chunk is passed on before it ends, and which of the runs is white space.
LONG_UNIT, BLANK = 1 << 12, 3
#: Characters of texts whose new units are encoded side by side.
SHARED = 1 << 18
#: Up to so many bytes pairs are scanned instead of queued; what stands for a pair that no merge joins, after all ranks.
SHORT, UNMERGED = 40, 1 << 40
NONE = (UNMERGED, -1)


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right that can matter for a token, of a list of merges by rank; raises where ranks aren't the order of work.

    reach[x]: how far left merges after the present one can move the last place
    at which two readings agree, if x stands right of it in one of them.  The
    merge (a, b) moves it over a where b stands there (then a b, or a alone,
    does), and leaves it where a stands there and grows to a b.
    """
    reach: dict[bytes, int] = {}
    for a, b in reversed(merges):
        grown, alone = reach.get(a + b, 0), reach.get(a, 0)
        right = max(reach.get(b, 0), len(a) + max(grown, alone))
        if max(grown, alone):
            reach[a] = max(grown, alone)
        reach[b] = max(reach.get(b, 0), right)
    latest: dict[bytes, int] = {}
    for rank, (a, b) in enumerate(merges):
        latest[a + b] = rank
    for rank, (a, b) in enumerate(merges):
        if max(latest.get(a, -1), latest.get(b, -1)) >= rank:
            raise ValueError(f"merge {rank} joins parts that a later merge makes, too")
    return max((n for x, n in reach.items() if len(x) == 1), default=0)


class Merges:
    """A merge list: ids of bytes, ranks of pairs of ids and what they make."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        import numpy as np

        self.byte = [ids.get(bytes([b]), -1) for b in range(256)]
        self.made = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.lookahead = lookahead(merges)
        self.width = {i: len(t) for t, i in ids.items()}
        self.span = 1 + max(ids.values())
        self.byte_ids = np.array(self.byte, dtype=np.int64)
        key = np.array([a * self.span + b for a, b in self.made], dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], np.array([r for r, _ in self.made.values()], dtype=np.int64)[order]
        self.makes = np.zeros(len(merges), dtype=np.int64)  # what the merge of each rank makes
        for rank, made in self.made.values():
            self.makes[rank] = made

    def encode(self, data: bytes) -> list[int]:
        """Ids of the whole of data: the lowest rank first, leftmost among equals."""
        made, ids = self.made, [self.byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        if n <= SHORT:
            return self._short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := made.get((ids[i], ids[i + 1])))]
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has changed
            ids[i], ids[j] = made[a, b][1], -2
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := made.get((ids[i], ids[k])):
                    heapq.heappush(agenda, (found[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (found := made.get((ids[h], ids[i]))):
                heapq.heappush(agenda, (found[0], h, ids[h], ids[i]))
        return [i for i in ids if i != -2]

    def _short(self, ids: list[int]) -> list[int]:
        """The same for few bytes, without an agenda."""
        made = self.made
        found = [made.get(pair, NONE) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = made.get((ids[i - 1], ids[i]), NONE)
            if i < len(found):
                found[i] = made.get((ids[i], ids[i + 1]), NONE)
        return ids

    def encode_many(self, units: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short units side by side: each round does the first of the best merges of every unit that has one."""
        import numpy as np

        size = np.array(list(map(len, units)), dtype=np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(units), dtype=np.uint8)]
        unit = np.repeat(np.arange(len(units)), size)
        found = [(unit[:0], sym[:0], sym[:0])]  # (unit, place, id) of finished units
        rank = self._ranks(sym, unit, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(sym)))
            live = np.repeat(best < UNMERGED, count)
            if not live.all():
                done = np.flatnonzero(~live)
                found.append((unit[done], done, sym[done]))
                sym, unit, rank = sym[live], unit[live], rank[live]
                if not len(sym):
                    break
                alive = best < UNMERGED
                best, count = best[alive], count[alive]
            at = np.flatnonzero(rank == np.repeat(best, count))
            at = at[np.append(True, unit[at[1:]] != unit[at[:-1]])]  # the first of each unit
            sym[at] = self.makes[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, unit, rank = sym[keep], unit[keep], rank[keep]
            at = at - np.arange(len(at))
            rank[at] = self._ranks(sym, unit, at)
            left = at[at > 0] - 1
            rank[left] = self._ranks(sym, unit, left)
        unit, place, sym = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(unit, kind="stable")  # all ids of a unit were finished together, in order
        ends = np.cumsum(np.bincount(unit, minlength=len(units))).tolist()
        ids = tuple(sym[order].tolist())
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _ranks(self, sym, unit, at):
        """Ranks of the pairs that start at places ``at``; UNMERGED where no merge joins them or a unit ends."""
        import numpy as np

        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.span + sym[after]
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        joined = (self.keys[spot] == key) & (unit[after] == unit[at]) & (after > at)
        return np.where(joined, self.ranks[spot], UNMERGED)


class Transducer:
    """Ids of one unit whose bytes come in parts; holds WINDOW bytes and the lookahead at most."""

    def __init__(self, merges: Merges, window: int = WINDOW):
        self.merges, self.window, self.held = merges, window, bytearray()

    def feed(self, data: bytes) -> list[int]:
        """The ids that no later byte can change."""
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            last = len(self.held) - self.merges.lookahead
            if last >= self.window:
                end = 0
                for i in self.merges.encode(bytes(self.held)):
                    if end + self.merges.width[i] > last:
                        break
                    end += self.merges.width[i]
                    out.append(i)
                del self.held[:end]
        return out

    def finish(self) -> list[int]:
        out = self.merges.encode(bytes(self.held))
        self.held.clear()
        return out


def _expected(first: int) -> tuple[int, int, int]:
    """Bytes of the code point that starts with byte first (0: none does), and the bounds of its second byte."""
    if first < 0x80:
        return 1, 0, 0
    if 0xC2 <= first < 0xE0:
        return 2, 0x80, 0xBF
    if 0xE0 <= first < 0xF0:
        return 3, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
    if 0xF0 <= first < 0xF5:
        return 4, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
    return 0, 0, 0


def unfinished(data: bytes) -> int:
    """How many of data's last bytes begin a code point that is not whole yet."""
    for n in range(1, min(3, len(data)) + 1):
        first = data[-n]
        if first & 0xC0 != 0x80:  # no continuation byte
            size, low, high = _expected(first)
            fits = n < 2 or low <= data[-n + 1] <= high
            return n if n < size and fits else 0
    return 0


class Decoder:
    """Text of ids that come in parts; its state is at most three bytes."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.state = tokens, b""

    def feed(self, ids) -> str:
        n = len(self.tokens)
        data = self.state + b"".join([self.tokens[i] for i in ids if i is not None and 0 <= i < n])
        keep = unfinished(data)
        self.state = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.state = self.state.decode("utf-8", "replace"), b""
        return out


class StreamBpe:
    """A byte-level BPE tokenizer file with the units of its pre-tokenizer; one is resident in a worker."""

    def __init__(self, path: str, pattern: str):
        import json

        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told["pre_tokenizer"], told["model"]
        if told["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} isn't plain byte-level BPE")
        to_byte = byte_of_character()
        raw = lambda token: bytes(to_byte[c] for c in token)
        ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(raw(a), raw(b)) for a, b in pairs], ids)
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.tokens[i] = token
        for text, i in self.added.items():
            self.tokens[i] = bytes(to_byte[c] for c in text) if all(c in to_byte for c in text) else text.encode()
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        odd = odd_code_points(path)
        self.units = regex.compile(pattern)
        self.odd = re.compile(f"[{odd}]") if odd else None
        self.far = re.compile(f"[{odd[:10]}-\\U0010ffff]") if odd else None  # from the first of them on: found faster
        fixed = lambda p: p.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[ODD])").replace(r" ?\p{L}+", r" ?(?:(?![ODD])\p{L})+").replace(r" ?\p{N}+", r" ?(?:(?![ODD])\p{N})+").replace("ODD", odd)
        self.odd_units = regex.compile(fixed(pattern)) if odd else self.units
        kinds = (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+")
        runs = [fixed(k) if odd else k for k in kinds]
        self.runs = [regex.compile(r[2:]) for r in runs] + [regex.compile(r"\s+")]
        self.kept = _Units(self.merges)

    def split(self, text: str):
        """The regex of the units of text: the plain one, unless it has code points that it would class otherwise."""
        plain = text.isascii() or self.odd is None or not self.far.search(text) or not self.odd.search(text)
        return self.units if plain else self.odd_units


class _Units(dict):
    """Ids of short units by the transducer; with KEPT_UNITS of them it forgets those not asked for since it was last full."""

    def __init__(self, merges: Merges):
        self.transducer, self.older = Transducer(merges), {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.older.get(unit)
        if ids is None:
            ids = tuple(self.transducer.feed(unit.encode()) + self.transducer.finish())
        if len(unit) <= 100:
            if len(self) >= KEPT_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids

    def learn(self, units: set[str]) -> None:
        """Makes ready the short ones of units, side by side."""
        new = [u for u in units if len(u) <= SHORT and u not in self and u not in self.older]
        raw = [u.encode() for u in new]
        if len(self) + len(new) > KEPT_UNITS:
            self.older = dict(self)
            self.clear()
        self.update(zip(new, self.transducer.merges.encode_many(raw), strict=True))


def byte_of_character() -> dict[str, int]:
    """The byte for each character of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def odd_code_points(path: str) -> str:
    """Ranges of the letters and numbers here that are neither for the tokenizer's library, whose Unicode version is older."""
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    new = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    odd = [ord(c) for c in regex.findall(r"\p{L}", new) if len(split("a" + c)) > 1] + [ord(c) for c in regex.findall(r"\p{N}", new) if len(split("1" + c)) > 1]
    ranges: list[list[int]] = []
    for c in sorted(odd):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Encoder:
    """Ids of a text that comes in chunks, as the whole text has them."""

    def __init__(self, bpe: StreamBpe):
        self.bpe, self.held, self.open, self.last = bpe, "", None, ""
        self.transducer = Transducer(bpe.merges)
        self.reach = max([len(t) for t in bpe.added] or [1]) - 1

    def feed(self, chunk: str) -> list[int]:
        """The ids that later chunks can't change."""
        return self._take(chunk, False)

    def finish(self) -> list[int]:
        return self._take("", True)

    def _take(self, chunk: str, final: bool) -> list[int]:
        """Cuts added tokens out; the last characters wait, as one may begin there."""
        text, out, at = self.held + chunk, [], 0
        if self.bpe.cut:
            for m in self.bpe.cut.finditer(text):
                out += self._units(text[at : m.start()], True)
                out.append(self.bpe.added[m.group()])
                at = m.end()
        stop = len(text) if final else max(at, len(text) - self.reach)
        self.held = text[stop:]
        return out + self._units(text[at:stop], final)

    def _units(self, text: str, final: bool) -> list[int]:
        """Units of a stretch.  The last two wait, unless the stretch ends here: no later text changes those before them."""
        text, out = self.last + text, []
        self.last = ""
        if self.open is not None:
            text = self._go_on(text, final, out)
            if self.open is not None:
                self.last = text
                return out
        bpe = self.bpe
        units = bpe.split(text).findall(text)
        waits = [] if final else units[-2:]
        out += chain.from_iterable(map(bpe.kept.__getitem__, units[: len(units) - len(waits)]))
        if waits and len(waits[-1]) >= LONG_UNIT:  # it stays open: what it has so far goes to the transducer
            for unit in waits[:-1]:
                out += bpe.kept[unit]
            unit = waits[-1]
            self.open = next(k for k, run in enumerate(bpe.runs) if run.fullmatch(unit[-1]))
            keep = len(unit) - (self.open == BLANK)
            out += self.transducer.feed(unit[:keep].encode())
            self.last = unit[keep:]
        else:
            self.last = "".join(waits)
        return out

    def _go_on(self, text: str, final: bool, out: list[int]) -> str:
        """Passes on what of text belongs to the open unit, and closes it where it ends; the rest.

        White space before other characters leaves its last one to them, so the last one always waits.
        """
        m = self.bpe.runs[self.open].match(text)
        end = m.end() if m else 0
        ends = final or end < len(text)
        if self.open == BLANK and end and not (final and end == len(text)):
            end -= 1
        out += self.transducer.feed(text[:end].encode())
        if ends:
            out += self.transducer.finish()
            self.open = None
        return text[end:]


def encode_chunks(bpe: StreamBpe, chunks):
    """Lists of ids of a text that is given as an iterable of chunks."""
    encoder = Encoder(bpe)
    for chunk in chunks:
        yield encoder.feed(chunk)
    yield encoder.finish()


def chunks_of(text: str | None):
    for at in range(0, len(text or ""), CHUNK):
        yield text[at : at + CHUNK]


def stream_bpe(name: str = "byte_bpe_50k") -> StreamBpe:
    """The public tokenizer ``name``."""

    def load() -> StreamBpe:
        import public_tokenizers

        return StreamBpe(public_tokenizers.path(f"{name}.json"), public_tokenizers.PATTERN)

    return resident(f"stream-bpe {name}", load)


def encode_texts(bpe: StreamBpe, texts: list[str | None]):
    """An array of ids for each text.  Texts of one chunk are split first and their new units encoded side by side, SHARED characters at a time."""
    import numpy as np

    out, waiting, size = [None] * len(texts), [], 0
    empty = np.empty(0, dtype=np.int32)

    def settle() -> None:
        bpe.kept.learn({u for _, units, ids in waiting if None in ids for u, x in zip(units, ids, strict=True) if x is None})
        for i, units, ids in waiting:
            if None in ids:
                ids = [bpe.kept[u] if x is None else x for u, x in zip(units, ids, strict=True)]
            out[i] = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
        waiting.clear()

    for i, text in enumerate(texts):
        if not text:
            out[i] = empty
        elif len(text) <= CHUNK and not (bpe.cut and bpe.cut.search(text)):
            units = bpe.split(text).findall(text)
            waiting.append((i, units, list(map(bpe.kept.get, units))))
            size += len(text)
            if size >= SHARED:
                settle()
                size = 0
        else:
            out[i] = np.concatenate([np.array(part, dtype=np.int32) for part in encode_chunks(bpe, chunks_of(text))])
    settle()
    return out


def _round_trip(name: str, back: bool):
    def run(batches):
        bpe = stream_bpe(name)
        for batch in batches:
            ids = encode_texts(bpe, batch["text"].tolist())
            out = pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})
            if back:
                out["decoded"] = ["".join(decode_parts(bpe, (own[at : at + CHUNK].tolist() for at in range(0, len(own), CHUNK)))) for own in ids]
            yield out

    return run


def decode_parts(bpe: StreamBpe, parts):
    """Stretches of text of ids that are given as an iterable of lists."""
    decoder = Decoder(bpe.tokens)
    for part in parts:
        yield decoder.feed(part)
    yield decoder.finish()


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids of each row of docs(doc_id, text)."""
    return map_slices(docs.select("doc_id", "text"), _round_trip(tokenizer, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids and decoded, the text that the ids decode to, of each row of docs(doc_id, text)."""
    return map_slices(docs.select("doc_id", "text"), _round_trip(tokenizer, True), "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and text of each row of rows(doc_id, ids); null ids give the empty text."""

    def run(batches):
        bpe = stream_bpe(tokenizer)
        for batch in batches:
            texts = []
            for ids in batch["ids"]:
                told = [] if ids is None else [None if i is None or i != i else int(i) for i in ids]
                texts.append("".join(decode_parts(bpe, [told])))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return map_slices(rows.select("doc_id", "ids"), run, "doc_id long, text string")
