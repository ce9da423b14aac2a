"""Token counts as a byte-pair vocabulary with word ends gives them: whole tokens from a table, merges for the rest."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsail.llm.textkit import unused

WORD_END = "</w>"
#: Code points whose class and normal form are asked of the library beforehand; parts of a text with others go to the library.
CODE_POINTS = 0x10000
#: Pieces of merged words that a task remembers, and the most characters of one.
REMEMBERED, REMEMBERED_LENGTH = 1 << 17, 48
#: Characters after which a text is cut at its next blank.
SLICE = 1 << 20
_BLANK = re.compile(r"[\t-\r ]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def _normal(text: str) -> str:
    """NFC and lower case, character by character: a sigma is small and not final wherever it stands."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need: all of it is bounded by the size of the vocabulary file and CODE_POINTS."""

    merges: dict[tuple[str, str], int]
    whole: list[str]
    pieces: str
    odd: str
    special: str
    file: str


def _library(file: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(file)
    t.no_padding()
    t.no_truncation()
    return t


def load(path: str) -> Vocabulary:
    """From a vocabulary file of the tokenizers library whose words end in </w>.

    Which characters are letters, digits, blanks or others is read off the library's
    own way of splitting, one code point at a time; a code point that it treats
    otherwise than here, or that Python's tables do not know, is odd. An entry
    of the vocabulary is a whole token if it is a piece by itself and merges to itself alone.
    """
    with open(path, encoding="utf-8") as f:
        file = f.read()
    spec, t = json.loads(file), _library(file)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END:
        raise ValueError("not a byte-pair vocabulary with word ends")
    merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    kinds: dict[str, list[int]] = {"letter": [], "digit": [], "blank": [], "other": [], "odd": []}
    count = t.pre_tokenizer.pre_tokenize_str
    for cp in range(CODE_POINTS):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Cn" or not c.isspace() and t.normalizer.normalize_str(c) != _normal(c):
            kind = "odd"
        else:  # of c twice a digit makes two pieces, a blank none; beside a letter only a letter makes one
            kind = {0: "blank", 2: "digit"}.get(len(count(c + c))) or ("letter" if len(count("b" + c)) == 1 else "other")
        kinds[kind].append(cp)
    letter, digit, blank, odd = (_ranges(kinds[k]) for k in ("letter", "digit", "blank", "odd"))
    pieces = f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{letter}{digit}{blank}]+"
    special = "|".join(re.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"])))
    byte_of, cut, whole = {c: b for b, c in enumerate(byte_letters())}, re.compile(pieces), []
    for entry in model["vocab"]:
        try:
            word = bytes(byte_of[c] for c in entry.removesuffix(WORD_END)).decode()
        except UnicodeDecodeError:
            continue
        if entry.endswith(WORD_END) and cut.findall(word) == [word] and _normal(word) == word and merged(word, merges) == 1:
            whole.append(word)
    return Vocabulary(merges, whole, pieces, f"[{odd}\\U{CODE_POINTS:08x}-\\U0010ffff]", special, file)


_LETTERS = byte_letters()


def merged(piece: str, merges: dict[tuple[str, str], int]) -> int:
    """Symbols left of a piece: the pair of lowest rank merges, the first one of equals, until none is left."""
    part: list[str | None] = [_LETTERS[b] for b in piece.encode()]
    if not part:
        return 0
    part[-1] += WORD_END
    after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
    queue = [(merges[pair], i, pair) for i, pair in enumerate(zip(part, part[1:])) if pair in merges]
    heapq.heapify(queue)
    left = len(part)
    while queue:
        _, i, (a, b) = heapq.heappop(queue)
        j = after[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (rank := merges.get((part[x], part[y]))) is not None:
                heapq.heappush(queue, (rank, x, (part[x], part[y])))
    return left


class _Pieces(dict):
    """Tokens of a piece: whole tokens from the start, others merged when they come up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.merges, self.most = vocabulary.merges, len(self) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = merged(piece, self.merges)
        if len(piece) <= REMEMBERED_LENGTH and len(self) < self.most:
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts in one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.file, self.pieces, self.odd = vocabulary.file, re.compile(vocabulary.pieces), re.compile(vocabulary.odd)
        self.special = re.compile(vocabulary.special) if vocabulary.special else None
        self.tokens, self.library = _Pieces(vocabulary), None

    def _plain(self, text: str) -> int:
        return sum(map(self.tokens.__getitem__, self.pieces.findall(text.lower() if text.isascii() else _normal(text))))

    def _odd(self, texts: list[str]) -> int:
        if self.library is None:
            self.library = _library(self.file)
        return len(self.library.encode(" ".join(texts), add_special_tokens=False).ids)

    def _slice(self, text: str) -> int:
        if self.odd.search(text) is None:
            return self._plain(text)
        # pieces and normal forms end at blanks, so each run between them stands for itself
        runs = [(x, self.odd.search(x) is not None) for x in _BLANK.split(text)]
        return self._plain(" ".join(x for x, odd in runs if not odd)) + self._odd([x for x, odd in runs if odd])

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special and "<" in text else [text]
        total = len(parts) - 1
        for part in parts:
            at = 0
            while at < len(part):
                cut = _BLANK.search(part, at + SLICE) if len(part) - at > SLICE else None
                end = cut.start() if cut else len(part)
                total += self._slice(part[at:end])
                at = end
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, carry: list[str], limit: int = 2048, text_col: str = "text") -> DataFrame:
    """carry and n_bytes, n_tokens, over_limit (more tokens than limit) of each row.

    Tokens are those of the library without begin, end or template tokens; strings
    of special tokens inside a text count one each, as they do there. A null text
    has no bytes and no tokens. Texts of any length are counted whole, a slice at a
    time. Rows are counted one by one: repeated ones agree, an empty table gives an
    empty result. Carried columns may have any names but those of the results.
    """
    if clash := {*carry} & {"n_bytes", "n_tokens", "over_limit"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.select(*carry, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias(unused("_text", carry)))
    schema = docs.select(*carry).schema.add("n_bytes", "long").add("n_tokens", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for batch in batches:
            n = [counter.count(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*carry, "n_bytes", "n_tokens"])

    return kept.mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit)
