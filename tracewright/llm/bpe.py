"""BPE encoding and decoding by prefix-sharing trie traversal.

``Vocabulary`` opens a tokenizers JSON file. Its normaliser and pre-tokeniser
cut a text into words; the merges are ours:

* Every prefix of a word has exactly one last token in its encoding. A token t
  that ends at place i is that token if the last token before t may stand left
  of t, that is, if the two alone encode to themselves.
* The distinct words of a batch go into a trie, held as its words in order. A
  depth-first walk carries the last tokens of the prefix down, so a prefix that
  many words share is encoded once; at a word's end the encoding is read backwards
  off those last tokens.
* Where a vocabulary marks word ends, the last symbol of a word differs from the
  same symbol inside; the walk tries it as a separate step that nothing shares.

Words of over ``LONG`` symbols are walked alone, without a trie. Encodings of
shorter words are kept in each worker process, up to ``CACHE`` words; then the
store is emptied and filled again, which changes no result. A null text is empty;
empty texts have no tokens, and no rows give no rows.

Texts in Latin-1 (they are in normal form NFC already) are cut with a plain
regular expression; all others go through the library's own normaliser and
pre-tokeniser. Added tokens in a text are found before that, as the library
does.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import kept

CACHE = 600_000
PIECE = 1 << 19
WORD = 24  # a word's characters on average, at most, for the store to hold CACHE words
LONG = 256  # words of more symbols share no prefixes
TAIL = 3  # so many last symbols tell how long a token can be

# The letters and numbers of Latin-1.
LATIN_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
WHITE = "\\t-\\r \\x85\\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: For a vocabulary that drops white space; for one that keeps it.
WORDS = re.compile(f"{CONTRACTIONS}|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+")
SPACED = re.compile(f"{CONTRACTIONS}| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


CUT = re.compile(f"(?<=[^{WHITE}\\x1c-\\x1f\\u1680\\u2000-\\u206f\\u3000]) (?=[^{WHITE}\\x1c-\\x1f\\u1680\\u2000-\\u206f\\u3000])")


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge rules alone, on words as strings of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.known: dict[str, bool | None] = dict.fromkeys(vocab)  # whether a token is whole; None until asked
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.made = {a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        self.one_way = len(self.made) == len(merges)  # every token has a single last merge
        self.pairs: dict[tuple[str, str], bool] = {}
        #: The most symbols of a token by its last TAIL ones, for tokens with the word-end mark and for others.
        self.reach: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        for token in vocab:
            marked = bool(end) and token.endswith(end) and len(token) > len(end)
            own, reach = (token[: -len(end)], self.ends) if marked else (token, self.reach)
            if len(own) > TAIL and len(own) > reach.get(own[-TAIL:], 0):
                reach[own[-TAIL:]] = len(own)

    def plain(self, symbols: list[str]) -> list[str]:
        """Merge by merge, lowest rank first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            inner = token[: -len(self.end)]
            return [*inner[:-1], inner[-1] + self.end]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether a token's own symbols merge into it; one that they don't reach is in no encoding."""
        if self.known.get(token, False) is None:
            self.known[token] = self.plain(self.symbols(token)) == [token]
        return self.known.get(token, False)

    def may_follow(self, a: str, b: str) -> bool:
        """Whether a and b, side by side, stay two tokens."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b) if self.one_way else self.plain(self.symbols(a) + self.symbols(b)) == [a, b]
        return found

    def _apart(self, a: str, b: str) -> bool:
        """may_follow by undoing merges: of the tokens at the border the one made last comes apart; if what then faces each other had a merge due before it, that would have come first. Of equal merges the left one is first."""
        rank, made = self.rank, self.made
        due = 1 << 60
        while True:
            if rank.get((a, b), due) < due:
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[2] > y[2]:
                a, due = x[1], x[2]
            else:
                b, due = y[0], y[2] + 1

    def _last(self, word: str, n: int, last: list[str | None], ending: str) -> str | None:
        """The last token of the word's first n symbols (with the word-end mark, if ending); last[i]: that of its first i symbols."""
        known, pairs = self.known, self.pairs
        reach = (self.ends if ending else self.reach).get(word[max(0, n - TAIL) : n], TAIL)
        for at in range(n - reach if n > reach else 0, n):
            token = word[at:n] + ending
            whole = known.get(token, False)
            if whole is None:
                whole = self.whole(token)
            if whole:
                if not at:
                    return token
                before = last[at]
                if before is not None:
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.may_follow(before, token):
                        return token
        return None

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each distinct word (symbols, without the word-end mark) and its tokens.

        The trie is its words in order: the path of a word leaves that of the word before where the two differ, and
        to go through them in order is to walk the trie depth first. last holds the states of the present path; those
        of the prefix that two words share stay, so that each prefix gets its state once.
        """
        last: list[str | None] = [None]
        above = ""
        for word in sorted(words):
            if len(word) > LONG:
                yield word, self._walk(word)
                continue
            shared, most = 0, min(len(word), len(above), len(last) - 1)
            while shared < most and word[shared] == above[shared]:
                shared += 1
            del last[shared + 1 :]
            # before a word-end mark the word's last symbol is another one, so that the whole word has a state only as the prefix of another
            for n in range(shared + 1, len(word) + (not self.end)):
                last.append(self._last(word, n, last, ""))
            yield word, self._back(word, last, self._last(word, len(word), last, self.end) if self.end else last[-1])
            above = word

    def _walk(self, word: str) -> list[str]:
        """The tokens of one word without a trie; in time and memory as its length."""
        last: list[str | None] = [None]
        for n in range(1, len(word) + (not self.end)):
            last.append(self._last(word, n, last, ""))
        return self._back(word, last, self._last(word, len(word), last, self.end) if self.end else last[-1])

    def _back(self, word: str, last: list[str | None], final: str | None) -> list[str]:
        tokens, at, token = [], len(word) + len(self.end), final
        while token is not None:
            tokens.append(token)
            at -= len(token)
            if not at:
                return tokens[::-1]
            token = last[at]
        return [t for t in self.plain(self.symbols(word + self.end)) if t in self.known]  # a symbol that the vocabulary lacks


class Vocabulary:
    """A tokenizers JSON file with our own merges and store of encoded words."""

    def __init__(self, path: str, engine: str = "trie", cache: int | None = None):
        """engine: "trie" for the walk above, "library" to let the tokenizers library merge each distinct word, when it first comes. cache: words that are kept, CACHE by default."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.engine = engine
        self.cache = cache or CACHE
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if engine == "trie":  # the library has its own
            self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], self.end)
            self.code = {t: i.to_bytes(4, "little") for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.spaced = spec["normalizer"] is None  # white space is kept, case too
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())}
        self.decoder = spec["decoder"]
        self.ids = _Store(self)
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})

    @cached_property
    def names(self) -> dict[int, str]:
        return {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    def words(self, text: str) -> list[str] | None:
        """The words of a text without added tokens; None where only the library can tell."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.spaced:
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return SPACED.findall(text) if self.spaced else WORDS.findall(text.lower())

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't stored by one walk over their trie."""
        names = {self._name(word): word for word in words}
        code = self.code
        for name, tokens in self.merges.encode_words(names):
            self.ids[names[name]] = b"".join([code[t] for t in tokens])

    def _name(self, word: str) -> str:
        """A word in the symbols that stand for its bytes."""
        return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.table)

    def _parts(self, text: str):
        """Lists of words, and added tokens as strings, in order."""
        if "<|" not in text or not self.split_added.search(text):
            yield from map(self.words, _pieces(text))
            return
        for i, part in enumerate(self.split_added.split(text)):
            if i % 2:
                yield part
            elif part:
                yield from map(self.words, _pieces(part))

    def _join(self, parts: list) -> bytes:
        ids = self.ids
        return b"".join([_pack([self.added[p]]) if isinstance(p, str) else b"".join(map(ids.__getitem__, p)) for p in parts])

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Words that aren't stored are encoded together, for the texts of about PIECE characters."""
        ids = self.ids
        at = 0
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and (not group or held + len(texts[at]) <= PIECE):
                group.append(texts[at])
                held += len(texts[at])
                at += 1
            if held > PIECE:  # one very long text, a piece at a time
                out = []
                for part in self._parts(group[0]):
                    self._learn_parts([[part]])
                    out.append(self._join([part]))
                yield b"".join(out)
                continue
            parts = [list(self._parts(t)) for t in group]
            self._learn_parts(parts)
            for own in parts:
                yield self._join(own)

    def _learn_parts(self, parts: list[list]) -> None:
        if self.engine == "library":
            return
        ids = self.ids
        words: set[str] = set()
        for own in parts:
            for part in own:
                if not isinstance(part, str):
                    words.update(part)
        missing = {w for w in words if w not in ids}
        if len(ids) + len(missing) > self.cache or ids.chars > WORD * self.cache:
            ids.clear()
            ids.chars, missing = 0, words
        ids.chars += sum(map(len, missing))
        self.learn(missing)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with skip_special_tokens=False: names joined by spaces, or bytes put together again where the file has a byte-level decoder."""
        names = self.names
        if self.decoder is None:
            return " ".join([names[i] for i in ids])
        symbols, added = self.bytes_of, set(self.added.values())
        return b"".join([names[i].encode() if i in added else bytes(symbols[c] for c in names[i]) for i in ids]).decode("utf-8", errors="replace")


class _Store(dict):
    """Encoded words. With the library as the engine, it adds a word when asked for it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.chars = 0  # of all words

    def __missing__(self, word: str) -> bytes:
        v = self.vocabulary
        if v.engine != "library":
            raise KeyError(word)
        if len(self) >= v.cache or self.chars > WORD * v.cache:
            self.clear()
            self.chars = 0
        self.chars += len(word)
        found = self[word] = _pack([t.id for t in v.library.model.tokenize(v._name(word))])
        return found


def _pieces(text: str) -> Iterator[str]:
    """The text, or pieces of about PIECE characters, cut before a single space between two characters that aren't white: no word spans such a place."""
    at = 0
    while len(text) - at > PIECE and (m := CUT.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def vocabulary(path: str, engine: str = "trie", cache: int | None = None) -> Vocabulary:
    """One for each worker process, kept between tasks."""
    return kept((path, engine, cache), lambda: Vocabulary(path, engine, cache))


def _encode(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        v = vocabulary(path)
        for batch in batches:
            ids, n, texts = [], [], []
            todo = [t or "" for t in batch.column(1).to_pylist()]
            for got in v.batch(todo):
                ids.append(got)
                n.append(len(got) // 4)
                if decoded:
                    texts.append(v.decode(np.frombuffer(got, dtype="<u4").tolist()))
            out = [batch.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * decoded, ["id", "ids", "n_tokens"] + ["decoded"] * decoded)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit), n_tokens, and the text decoded from the ids if asked for. A null text is empty; empty texts have no ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, decoded), "id long, ids binary, n_tokens long" + ", decoded string" * decoded)
