"""Byte-pair encoding by a walk over the prefix tree of the distinct words (free style).

A tokenizer file gives the merge rules. Every text is normalised and cut into words, and
only words that are new to the task are encoded. Sorted, they are the prefix tree in
depth-first order: the state of a node is the last token of the encoding of its prefix,
and the states of the prefix that a word shares with its predecessor are reused. The last
token of a prefix is the one token ending there that the tokens before it would not have
merged with; following the last tokens from the end of the word gives its encoding.

Nothing is shuffled: a task keeps its words in a cache of at most `CACHED_WORDS` entries,
which is a saving only and never changes a result.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posewatch.llm import tables

CACHED_WORDS = 500_000
END = "</w>"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    spare = 0x100
    for b in range(0x100):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(0x100)]


def char_class(points: list[int]) -> regex.Pattern:
    """Pattern of one character out of the given rising code points."""
    ranges, start = [], None
    for c, after in zip(points, [*points[1:], None], strict=True):
        start = c if start is None else start
        if after != c + 1:
            ranges.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return regex.compile(f"[{''.join(ranges)}]" if ranges else "(?!)")


class Newer:
    """Code points that Python's tables have not assigned.

    Python, the pattern library and the tokenizers library follow different Unicode
    versions and agree on what the oldest, Python's, has assigned. For the rest the
    tokenizers library is asked: how it normalises a text with such a character, and
    which of those that the pattern library takes for letters or numbers it does not.
    """

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        points = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
        named = regex.compile(r"[\p{L}\p{N}]")
        cut = library.pre_tokenizer.pre_tokenize_str
        self.any = char_class(points)
        # In one piece with a mark: neither a letter nor a number.
        self.no_letter = char_class([c for c in points if named.match(chr(c)) and len(cut("!" + chr(c))) == 1])
        self.normalized = library.normalizer.normalize_str

    def within(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.search(text) is not None
        return False


class WordEncoder:
    """Vocabulary, merge order and the walk over the prefix tree."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is the Unicode property, without the separators U+001C to U+001F.
        space = r"\t-\r \x85\xa0  -     　"
        self.space = regex.compile(f"[{space}]+")
        self.separators = regex.compile("[\x1c-\x1f]")
        self.split = regex.compile(split.replace(r"\s", space))
        self.newer = Newer(path)
        self.letters = byte_letters()
        self.names = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, (a, b) in enumerate(model["merges"]):
            pair, token = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.merged.setdefault(pair, (rank, token))
            self.parts.setdefault(token, (rank, *pair))
        self.known: dict[tuple[int, int], bool] = {}
        # A token that its own text is not encoded to never ends a prefix.
        usable = {
            t: i
            for t, i in self.vocab.items()
            if i not in self.parts or self._stays(*self.parts[i][1:], self.parts[i][0])
        }
        # Texts of tokens that end words, without the mark; and all beginnings of tokens,
        # with the token if the beginning is one and -1 if not.
        self.finals = {t.removesuffix(END): i for t, i in usable.items() if t.endswith(END)}
        plain = {t.removesuffix(END): i for t, i in usable.items() if not t.endswith(END)}
        self.starts = {t[:n]: -1 for t in (*plain, *self.finals) for n in range(1, len(t) + 1)}
        self.starts |= plain
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def cut(self, chunk: str) -> list[str]:
        """Words of a chunk without white space."""
        if chunk.isascii() or not self.newer.no_letter.search(chunk):
            return self.split.findall(chunk)
        # U+0378 is no letter in any version; what it stands for is cut as it is.
        spans = self.split.finditer(self.newer.no_letter.sub("\u0378", chunk))
        return [chunk[m.start() : m.end()] for m in spans]

    def _stays(self, left: int, right: int, until: int) -> bool:
        """Whether no merge across the border comes before the rank `until`.

        Both tokens are taken apart along the border, the younger one first. A merge
        of two parts happens if its rank is below the ranks that used the parts up; at
        equal ranks the pair further left goes first.
        """
        limit = (until, 0)
        while True:
            found = self.merged.get((left, right))
            if found and (found[0], 1) < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = (a[0], 0), a[2]
            else:
                limit, right = (b[0], 2), b[1]

    def _adjacent(self, left: int, right: int) -> bool:
        if len(self.known) > 1_000_000:
            self.known.clear()
        found = self.known[left << 20 | right] = self._stays(left, right, 1 << 60)
        return found

    def encode_words(self, words: list[str]) -> None:
        """Encode words in sorted order, sharing the states of common prefixes."""
        starts, finals, known = self.starts.get, self.finals.get, self.known.get
        spelled = sorted(
            (w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode())), w)
            for w in words
        )
        before = ""
        last, size, low = [0], [0], [0]  # states of the prefixes of `before`
        for s, word in spelled:
            n, keep = len(s), 0
            most = min(len(before), n) - 1
            while keep < most and s[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :], size[keep + 1 :], low[keep + 1 :]
            j = low[keep]
            for i in range(keep + 1, n):
                token = starts(s[j:i])
                while token is None:
                    j += 1
                    token = starts(s[j:i])
                first = j
                while token < 0 or (
                    j
                    and not (
                        found
                        if (found := known(last[j] << 20 | token)) is not None
                        else self._adjacent(last[j], token)
                    )
                ):
                    j += 1
                    token = starts(s[j:i], -1)
                last.append(token)
                size.append(i - j)
                low.append(first)
                j = first
            token = finals(s[j:])
            while token is None or (j and not self._adjacent(last[j], token)):
                j += 1
                token = finals(s[j:])
            ids = [token]
            while j:
                ids.append(last[j])
                j -= size[j]
            ids.reverse()
            self.words[word] = tuple(ids)
            before = s

    def pieces(self, text: str) -> list[str | int]:
        """The text between white spaces, and the ids of special tokens written in it."""
        out: list[str | int] = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                if not part.isascii():
                    if self.newer.within(part):
                        part = self.newer.normalized(part)
                    # lower case is taken letter by letter, so sigma has one form
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if self.separators.search(part):
                    out += filter(None, self.space.split(part.lower()))
                else:
                    out += part.lower().split()
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. Words never reach over white space, so the chunks between
        white spaces are looked up, and only new ones are cut into words."""
        cut = [self.pieces(t or "") for t in texts]
        wanted = {c for chunks in cut for c in chunks}
        if len(self.chunks) + len(wanted) > CACHED_WORDS:
            self.chunks.clear()
            self.words.clear()
        new = {
            c: (c,) if isinstance(c, int) else self.cut(c)
            for c in wanted
            if c not in self.chunks
        }
        get = self.words.get
        self.encode_words(
            [w for w in {w for words in new.values() for w in words} if isinstance(w, str) and get(w) is None]
        )
        for c, words in new.items():
            if isinstance(c, int):
                self.chunks[c] = words
            elif len(words) == 1:
                self.chunks[c] = self.words[words[0]]
            else:
                self.chunks[c] = tuple(chain.from_iterable(map(self.words.__getitem__, words)))
        have = self.chunks.__getitem__
        return [list(chain.from_iterable(map(have, chunks))) for chunks in cut]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns `id_col`, `ids` (array of int) and `decoded`, one row for each input row,
    repeated ids included. A null text counts as empty and gives no ids and an empty
    decoded text; a null id stays null; other columns are not looked at; an empty
    table gives no rows. `path` must be readable on the executors.
    """

    def work(columns: list[list]) -> list[list]:
        e = encoder(path)
        ids = e.encode(columns[1])
        return [columns[0], ids, [e.decode(x) for x in ids]]

    kind = dict(df.dtypes)[id_col]
    return tables.map_rows(
        df, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>, decoded string", work
    )


def ids_text(ids: str = "ids") -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
