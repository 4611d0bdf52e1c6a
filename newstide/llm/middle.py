"""Fill-in-middle documents: units by lookaround splits, two keyed cuts, and sentinels.

A unit grammar names classes of characters and how they make units, as a list
of alternatives such as ``S*W+|S+``.  Where a unit of such a grammar ends is
told by the two characters beside the place alone, so :func:`boundary` turns it
into a regex of zero width, ``(?<=[last of a unit])(?=[first of the next])``:
it follows every class that a reading of the grammar can be in, finds for each
pair of neighbouring classes whether a unit ends between them, and refuses a
grammar in which that depends on more.  ``split`` at that regex keeps every
character, so the pieces join to the text.

Cuts, form and order of the parts come from the sha256 of the seed and the
document's id; everything is DataFrame functions, and a row needs no other.

Nulls and edge cases: null text is empty; an empty text has no units (a split
would give one) and is plain, as is a text that holds a sentinel; a null doc_id
is keyed as ``null``; rows that repeat an id are cut alike; an empty table gives
none; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels of prefix, suffix and middle, and white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
#: (grammar, the inside of a character class for each letter; one class may be None: all other characters).
GRAMMARS = {
    "words": ("S*W+|S+", {"S": SPACE, "W": None}),
    "words_then_space": ("W+S*|S+", {"S": SPACE, "W": None}),
    "lines": ("T*N|T+", {"N": r"\x0A", "T": None}),
    "characters": ("C", {"C": None}),
    "classes": ("L+|D+|S+|O+", {"L": r"\p{L}\p{M}", "D": r"\p{N}", "S": SPACE, "O": None}),
}


def _parts(grammar: str) -> list[list[tuple[str, str]]]:
    """Alternatives of (class, quantifier)."""
    out = []
    for alternative in grammar.split("|"):
        atoms = re.findall(r"([A-Z])([*+?]?)", alternative)
        if not atoms or "".join(a + q for a, q in atoms) != alternative:
            raise ValueError(f"can't read {alternative!r}: letters with *, + or ?")
        out.append(atoms)
    return out


def _steps(parts, places: frozenset, letter: str) -> frozenset:
    """The places (alternative, atom) that a reading can be in after ``letter``; places of None is a unit's start."""
    found = set()
    for k, at in places:
        atoms = parts[k]
        first = max(at, 0)
        repeats = at >= 0 and atoms[at][1] in ("*", "+")
        for i in range(first, len(atoms)):
            if i == at and not repeats:
                continue
            if atoms[i][0] == letter:
                found.add((k, i))
            if i != at and atoms[i][1] not in ("*", "?"):
                break  # this one can't be left out
    return frozenset(found)


def boundaries(grammar: str, letters: list[str]) -> set[tuple[str, str]]:
    """Pairs of neighbouring classes between which a unit ends, of the grammar's longest units."""
    parts = _parts(grammar)
    start = frozenset((k, -1) for k in range(len(parts)))
    told: dict[tuple[str, str], bool] = {}
    seen, todo = set(), [(_steps(parts, start, a), a) for a in letters]
    while todo:
        places, last = todo.pop()
        if not places:
            raise ValueError(f"{grammar}: no unit starts with {last}")
        if (places, last) in seen:
            continue
        seen.add((places, last))
        whole = any(all(q in ("*", "?") for _, q in parts[k][i + 1 :]) for k, i in places)
        for letter in letters:
            on = _steps(parts, places, letter)
            ends = not on
            if ends and not whole or told.setdefault((last, letter), ends) != ends:
                raise ValueError(f"{grammar}: more than the two characters tells whether a unit ends between {last} and {letter}")
            todo.append((on or _steps(parts, start, letter), letter))
    return {pair for pair, ends in told.items() if ends}


def boundary(grammar: str, classes: dict[str, str | None]) -> str:
    """The zero-width regex of a grammar's boundaries (Java's syntax)."""
    letters = list(classes)
    pairs = boundaries(grammar, letters)
    others = "".join(v for v in classes.values() if v)
    inside = lambda c: f"[{classes[c]}]" if classes[c] else f"[^{others}]" if others else r"[\s\S]"
    # between the halves of a surrogate pair, where Java's regexes stop, too, there is no boundary
    sides = [f"(?<={inside(a)})(?=(?:{'|'.join(inside(b) for b in letters if (a, b) in pairs)}))" for a in letters if any((a, b) in pairs for b in letters)]
    return r"(?![\uDC00-\uDFFF])(?:" + "|".join(sides) + ")" if sides else r"\b\B"


def units(text: Column, grammar: str = "words") -> Column:
    """Units of a text; none of an empty or null one."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(*GRAMMARS[grammar]), -1))


def transform(docs: DataFrame, grammar: str = "words", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix and output of each row of docs(doc_id, text); parts are null where the form is plain."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring("_key", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
    rows = rows.select("doc_id", "text", units(F.col("text"), grammar).alias("_u"), *[x.alias(f"_h{k}") for k, x in enumerate(h)])
    rows = rows.withColumn("n", F.size("_u").cast("bigint"))
    a, b = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    taken = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        taken = taken | F.contains("text", F.lit(sentinel))
    form = F.when((F.col("text") == "") | taken | (F.col("_h2") % 100 >= percent), "plain").when(F.col("_h3") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"_a": F.least(a, b).cast("int"), "_b": F.greatest(a, b).cast("int"), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_u", start, length), ""))
    rows = rows.withColumns({"prefix": part(F.lit(1), F.col("_a")), "middle": part(F.col("_a") + 1, F.col("_b") - F.col("_a")), "suffix": part(F.col("_b") + 1, F.col("n").cast("int"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that a row's output was made from: no part holds a sentinel, nor do a part and a sentinel beside it make one."""
    p = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)  # what stands before the first sentinel is empty
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)
