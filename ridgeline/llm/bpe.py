"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the encoder stores the one token that ends the
prefix's encoding.  The candidates are the vocabulary tokens that are suffixes
of the prefix (found by an Aho-Corasick automaton over the vocabulary, which gives all of a prefix's suffixes that are tokens); a candidate is
right if the token stored for what precedes it is *compatible*: merging the two
tokens' texts together gives just these two tokens.  Exactly one candidate
passes, so following the back-pointers from the last prefix gives the ids that
merging in rank order would give, in time linear in the word.

Words repeat, so each worker keeps a bounded table of encoded chunks (runs of
text between white space); only new chunks reach the dynamic program.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_CHUNKS, CACHE_WORDS = 700_000, 800_000  # most entries of a worker's tables, which start anew when full
# Python's str.split() also splits at these; the tokenizer doesn't call them white space
ODD_SPACE = regex.compile("[\x1c-\x1f]")
END = 0xE000  # symbols that end a word are moved here, each to one code point


def byte_symbols() -> list[str]:
    """The printable code point that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixBpe:
    """Encoder and decoder for a vocabulary file with merges and a word-end suffix."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.names: dict[int, str] = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: s for s, i in self.special.items()})
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.normalizer = Tokenizer.from_file(path).normalizer
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.symbols = byte_symbols()
        self.vocab = {self.folded(s): i for s, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # a merge's rank, and for each merged token its parts
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        raw = model["vocab"]
        for r, (a, b) in enumerate(merges):
            pair = (raw[a], raw[b])
            self.rank[pair] = r
            self.made.setdefault(raw[a + b], (r, *pair))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        reached: dict[int, bool] = {}
        for s, i in sorted(self.vocab.items(), key=lambda x: len(x[0])):
            reached[i] = self.own(s, i, reached)
            if reached[i]:
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.table: dict[str, bytes] = {}
        self.spoken: dict[str, str] = {}
        self.known_words: dict[str, array] = {}

    def folded(self, token: str) -> str:
        """A token's text with the word end folded into its last symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(END + ord(token[-1]))
        return token

    def own(self, symbols: str, token: int, reached: dict[int, bool]) -> bool:
        """Whether the token's text encodes as the token itself: its last merge joins two such parts that stay apart until then."""
        parts = self.made.get(token)
        if parts is None:
            return len(symbols) == 1
        return reached[parts[1]] and reached[parts[2]] and self.fits(parts[1], parts[2], parts[0])

    def fits(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether no merge of rank under ``below`` joins anything across the border of two tokens.

        Undo both tokens' merges, latest first: whenever a pair of parts faces
        each other over the border, a merge of the two would have happened if it
        ranks before the merges that took either part away from the border.
        """
        gone, made, rank = below, self.made, self.rank
        while True:
            r = rank.get((left, right))
            if r is not None and r < gone:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            # Of equal ranks the left one merged first, so it is undone last; and
            # a merge over the border comes before an equal one to its right.
            if b is None or (a is not None and a[0] > b[0]):
                gone, left = a[0], a[2]
            else:
                gone, right = b[0] + 1, b[1]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word of byte symbols, its last symbol moved to ``END``."""
        n = len(word)
        last: list[tuple[int, int] | None] = [None] * n  # per prefix: its last token and that token's length
        known, fits = self.compatible, self.fits
        for at, hit in self.automaton.iter(word):  # by end, so what a candidate builds on is settled
            if last[at] is not None:
                continue
            size, token = hit
            if size == at + 1:
                last[at] = (token, size)
                continue
            before = last[at - size]
            if before is None:
                continue
            pair = (before[0], token)
            ok = known.get(pair)
            if ok is None:
                if len(known) > 500_000:
                    known.clear()
                ok = known[pair] = fits(*pair)
            if ok:
                last[at] = (token, size)
        out, at = [], n - 1
        while at >= 0:
            step = last[at]
            if step is None:
                raise ValueError(f"the vocabulary can't spell {word!r}")
            out.append(step[0])
            at -= step[1]
        return out[::-1]

    def encode_words(self, normal: str) -> list[int]:
        """Ids of normalised text without special tokens: split into words, encode each."""
        ids: list[int] = []
        symbols, known = self.symbols, self.known_words
        for word in self.words.findall(normal):
            got = known.get(word)
            if got is None:
                s = "".join([symbols[b] for b in word.encode()])
                got = array("I", self.encode_word(s[:-1] + chr(END + ord(s[-1])) if self.suffix else s))
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[word] = got
            ids += got
        return ids

    def encode_plain(self, text: str) -> list[int]:
        return self.encode_words(self.normalizer.normalize_str(text))

    def encode(self, text: str) -> list[int]:
        parts = self.special_at.split(text) if self.special_at else [text]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                ids += self.encode_plain(part)
        return ids

    def decode(self, ids) -> str:
        """What the library makes of ids for a vocabulary without a decoder: their texts between blanks."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def learn(self, chunks: list[str]) -> None:
        """Enter chunks without white space into the tables."""
        if len(self.table) + len(chunks) > CACHE_CHUNKS:
            self.table.clear()
            self.spoken.clear()
        plain = [c for c in chunks if "<|" not in c]
        said = self.normalizer.normalize_str(" ".join(plain)).split(" ") if plain else []  # no chunk holds or becomes white space
        for c, text in zip(plain, said, strict=True):
            ids = self.encode_words(text)
            self.table[c], self.spoken[c] = array("I", ids).tobytes(), self.decode(ids)
        for c in chunks:
            if "<|" in c:
                ids = self.encode(c)
                self.table[c], self.spoken[c] = array("I", ids).tobytes(), self.decode(ids)

    def batch(self, texts: list[str], step: int = 100_000) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and their decoding.

        What the tables lack is looked for once for about ``step`` chunks of all the texts.
        """
        waiting: list[list[str] | str] = []
        size = 0
        for text in texts:
            waiting.append(text if ODD_SPACE.search(text) else text.split())
            size += len(waiting[-1])
            if size >= step:
                yield from self.encoded(waiting)
                waiting, size = [], 0
        yield from self.encoded(waiting)

    def encoded(self, waiting: list[list[str] | str]) -> Iterator[tuple[bytes, str]]:
        table = self.table
        lists = [x for x in waiting if not isinstance(x, str)]
        new = {c for x in lists for c in x if c not in table}
        if len(table) + len(new) > CACHE_CHUNKS:  # the tables are about to start anew
            new = {c for x in lists for c in x}
        if new:
            self.learn(list(new))
        for x in waiting:
            if isinstance(x, str):
                ids = self.encode(x)
                yield array("I", ids).tobytes(), self.decode(ids)
            else:
                yield b"".join(map(table.__getitem__, x)), " ".join(filter(None, map(self.spoken.__getitem__, x)))


@lru_cache(maxsize=2)
def coder(path: str) -> PrefixBpe:
    """One encoder for each worker process and vocabulary."""
    return PrefixBpe(path)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: ``(<id_col>, ids binary, decoded string)``, a row for a row.

    ``ids`` holds little-endian unsigned 32-bit integers.  A null text counts as
    empty and gives no ids; a null id is passed on; repeated rows give repeated
    results; an empty table gives an empty one; other columns are ignored.  The
    file must be at ``vocab_path`` on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = coder(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = list(bpe.batch([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())],
                    ["_id", "ids", "decoded"],
                )

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(
        run, f"_id {kind}, ids binary, decoded string"
    )
    return got.withColumnRenamed("_id", id_col)
