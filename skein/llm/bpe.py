"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoder. A token sequence is the merge list's encoding of its text exactly when every two neighbours are: merging
the text of the two alone gives the same two tokens. So each prefix of a word has one encoding, given by its last
token and the encoding of what stands before it; and whatever follows, the token across the current position
starts within the last ``lookahead`` characters, where ``lookahead`` is the longest token that the merge list can
make. Tokens on which the encodings of all those starts agree can't change any more: they are emitted and
forgotten. The state is a window of a few lookaheads, however long the word is.

A text passes in segments of bounded size, cut at white space, and segments in windows of bounded size, whatever the
length of the text; ids and decoded text go into running digests. Words of a window are many and mostly short, so
words that fit into the machine's own window run through it in lockstep, one letter position of all of them at a
time; longer ones are pushed letter by letter. Words repeat, so finished white-space chunks are memoised in a table of
bounded size.

Decoder. A state machine takes token strings as they come and gives text. Where the tokenizer file names no decoder its
library joins the strings by a blank: the state is whether one was given. For the text itself, end marks become
blanks and letters bytes, and the state is the at most three pending bytes of an unfinished UTF-8 sequence.

Defined results: null text is empty and gives no tokens (both hashes are those of the empty string); invalid UTF-8
is read with replacement characters; strings of special tokens in a text become those tokens; repeated rows are
encoded each for itself; an empty table gives no rows; extra columns are dropped. A run without any white space is
one segment.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, read, small_batches

VOCABULARY = "word_bpe_49k.json"
#: White-space chunks, and words, remembered by a worker, in each of two generations (about 100 MB in all).
MEMO = 60_000
#: Characters of a segment of a text, and of a window of segments.
SEGMENT, WINDOW = 1 << 16, 1 << 21
_ODD = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"(?![\x1c-\x1f])\s")
_PIECE = regex.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Transducer:
    """Encodes words letter by letter. ``push`` takes letters and returns tokens that are stable; ``close`` ends
    the word (its last letter carries the end mark) and returns the rest. ``encode_words`` runs the same machine
    over many short words in lockstep, one letter position at a time, in NumPy."""

    SLOTS = 1 << 20
    FITS = 1 << 21
    LONG = 64

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for i, (a, b) in enumerate(merges):
            if a + b in vocab:
                self.rank.setdefault((a, b), i)
                self.halves.setdefault(a + b, (a, b))
        letters = {t for t in vocab if len(self.body(t)) == 1}
        #: Tokens that merging can make from their own letters.
        self.tokens = {t for t in self.halves if self.merge(self.split(t)) == [t]} | letters
        #: The merge list's sufficient lookahead: no token is longer.
        self.lookahead = max((len(self.body(t)) for t in self.tokens), default=1)
        self.fits = lru_cache(maxsize=1 << 14)(self._fits)
        self.reset()

    def body(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token

    def reset(self) -> None:
        self.text, self.last, self.base_token = "", [None], None

    def split(self, token: str) -> list[str]:
        body = self.body(token)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def merge(self, parts: list[str]) -> list[str]:
        """Plain merging by rank, leftmost first: the definition, for single tokens and for tests."""
        parts = list(parts)
        while len(parts) > 1:
            ranks = [self.rank.get(p, -1) for p in zip(parts, parts[1:])]
            found = [r for r in ranks if r >= 0]
            if not found:
                break
            i, best, out = 0, min(found), []
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one edge of the token while it is merged: each symbol with the rank that ends it."""
        out, ends = [], len(self.rank) + len(self.halves) + 1
        while True:
            out.append((token, ends))
            if token not in self.halves:
                return out[::-1]
            ends = self.rank[self.halves[token]]
            token = self.halves[token][side]

    def _fits(self, left: str, right: str) -> bool:
        """Whether the two stay two when their letters are merged together: no merge across the seam comes before
        the merges that consume what stands there (of equal ranks the leftmost comes first)."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            cross = self.rank.get((x, y))
            if cross is not None and cross < x_ends and cross <= y_ends:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if x_ends <= y_ends and i < len(a) - 1 or j == len(b) - 1:
                i += 1
            else:
                j += 1

    def _last_token(self, stop: int, mark: str) -> str | None:
        """The token that ends the encoding of the letters up to ``stop``."""
        text, last = self.text, self.last
        for start in range(max(0, stop - self.lookahead), stop):
            token = text[start:stop] + mark
            if token in self.tokens:
                before = last[start] if start else self.base_token
                if before is None:
                    if start == 0:
                        return token
                elif self.fits(before, token):
                    return token
        return None

    def push(self, letters: str) -> list[str]:
        out: list[str] = []
        for c in letters:
            self.text += c
            self.last.append(self._last_token(len(self.text), ""))
            if len(self.text) >= 8 * self.lookahead:
                out += self._settle()
        return out

    def _walk(self, stop: int) -> list[str]:
        out = []
        while stop > 0:
            token = self.last[stop]
            out.append(token)
            stop -= len(token)
        return out[::-1]

    def _settle(self) -> list[str]:
        """Emits what the encodings of all possible starts of the next token have in common."""
        n = len(self.text)
        heads = {p for p in range(max(0, n - self.lookahead), n + 1) if p == 0 or self.last[p] is not None}
        while len(heads) > 1:
            p = max(heads)
            heads.discard(p)
            heads.add(p - len(self.last[p]))
        common = heads.pop()
        if common <= 0:
            return []
        out = self._walk(common)
        self.base_token = out[-1]
        self.text, self.last = self.text[common:], [None, *self.last[common + 1 :]]
        return out

    def close(self) -> list[str]:
        n = len(self.text)
        token = self._last_token(n, self.end) if n else None
        out = [] if token is None else [*self._walk(n - len(self.body(token))), token]
        self.reset()
        return out

    def encode_word(self, word: str) -> list[str]:
        self.reset()
        out = self.push(word)
        return out + self.close()

    # The lockstep form. Tokens are found by a rolling hash of their letters' bytes in an open-addressed table.
    P, MIX, ENDED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def prepare(self, byte_of: dict[str, int]) -> None:
        self.names = sorted(self.tokens, key=lambda t: self.vocab[t])
        self.slot_key, self.slot_id = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.probes = 1
        self.power = np.ones(self.LONG + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, self.LONG + 1):
                self.power[i] = self.power[i - 1] * self.P
        mask, p = (1 << 64) - 1, int(self.P)
        for i, t in enumerate(self.names):
            h, body = 0, self.body(t)
            for c in body:
                h = (h * p + byte_of[c] + 1) & mask
            h = ((h + (len(body) << 56)) * int(self.MIX)) & mask
            if body != t:
                h ^= int(self.ENDED)
            at, n = h >> 44, 1
            while self.slot_id[at] >= 0:
                at, n = (at + 1) % self.SLOTS, n + 1
            self.slot_key[at], self.slot_id[at] = h, i
            self.probes = max(self.probes, n)
        self.size_list = [len(self.body(t)) for t in self.names]
        self.fit_key, self.fit = np.full(self.FITS, -1, np.int64), np.zeros(self.FITS, bool)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(44)).astype(np.int64)
        key, ids = self.slot_key[at], self.slot_id[at]
        out = np.where(key == h, ids, np.int32(-1))
        todo = np.nonzero((ids >= 0) & (key != h))[0]
        for k in range(1, self.probes):
            if not len(todo):
                break
            a = (at[todo] + k) % self.SLOTS
            key, ids = self.slot_key[a], self.slot_id[a]
            hit = (key == h[todo]) & (ids >= 0)
            out[todo[hit]] = ids[hit]
            todo = todo[(ids >= 0) & ~hit]
        return out

    def _fit_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = (key * 0x9E3779B1 >> 7) % self.FITS
        new = np.nonzero(self.fit_key[at] != key)[0]
        out = self.fit[at]
        if len(new):
            uniq, back = np.unique(key[new], return_inverse=True)
            got = np.array([self._fits(self.names[k >> 20], self.names[k & 0xFFFFF]) for k in uniq.tolist()], bool)
            out[new] = got[back]
            self.fit_key[at[new]], self.fit[at[new]] = key[new], out[new]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Indexes into ``names`` for each word of at most ``LONG`` bytes."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        with np.errstate(over="ignore"):
            for n, where in by_size.items():
                if n:
                    self._lockstep(n, where, words, out)
        return out

    def _lockstep(self, n: int, where: list[int], words: list[bytes], out: list[list[int]]) -> None:
        letters = np.frombuffer(b"".join([words[i] for i in where]), np.uint8).reshape(-1, n)
        pre = np.zeros((n + 1, len(where)), np.uint64)
        for i in range(n):
            pre[i + 1] = pre[i] * self.P + (letters[:, i].astype(np.uint64) + np.uint64(1))
        last = np.full((n + 1, len(where)), -1, np.int32)
        for stop in range(1, n + 1):
            todo = np.arange(len(where))
            for start in range(max(0, stop - self.lookahead), stop):
                k = stop - start
                h = (pre[stop][todo] - pre[start][todo] * self.power[k] + np.uint64(k << 56)) * self.MIX
                if stop == n:
                    h ^= self.ENDED
                token = self._find(h)
                hit = np.nonzero(token >= 0)[0]
                if start and len(hit):
                    before = last[start][todo[hit]]
                    hit, before = hit[before >= 0], before[before >= 0]
                    hit = hit[self._fit_many(before, token[hit])]
                if len(hit):
                    last[stop][todo[hit]] = token[hit]
                    todo = np.delete(todo, hit)
                    if not len(todo):
                        break
        last, size = last.T.tolist(), self.size_list
        for i, row in zip(where, last):
            got, at = out[i], n
            while at > 0:
                t = row[at]
                got.append(t)
                at -= size[t]
            got.reverse()


class Utf8Decoder:
    """Bytes to text as they come: holds an unfinished sequence, replaces what can't be one."""

    def __init__(self):
        self.pending = b""

    def push(self, data: bytes, final: bool = False) -> str:
        data = self.pending + data
        keep = 0
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead >= 0xC0:
                    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    keep = back if need > back else 0
                    break
                if lead < 0x80:
                    break
        self.pending = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")


class Decoder:
    """Token strings to text as they come, in the library's way for a file without a decoder: joined by one blank."""

    def __init__(self):
        self.begun = False

    def push(self, tokens: str) -> str:
        """``tokens``: one or more token strings, joined by one blank."""
        if not tokens:
            return ""
        out = f" {tokens}" if self.begun else tokens
        self.begun = True
        return out


class TextDecoder:
    """Token strings to the (normalised) text that they stand for, as they come."""

    def __init__(self, back: dict[str, int], end: str):
        self.back, self.end, self.state = back, end, Utf8Decoder()

    def push(self, token: str) -> str:
        ended = bool(self.end) and token.endswith(self.end)
        out = self.state.push(bytes([self.back[c] for c in (token[: -len(self.end)] if ended else token)]), ended)
        return f"{out} " if ended else out

    def close(self) -> str:
        return self.state.push(b"", True)


class Encoding:
    """The running result of one text."""

    def __init__(self, with_ids: bool = False):
        self.n, self.ids, self.decoded, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder()
        self.raw: list[int] | None = [] if with_ids else None

    def add(self, n: int, ids: str, names: str) -> None:
        if n:
            self.ids.update((f" {ids}" if self.n else ids).encode())
            self.decoded.update(self.decoder.push(names).encode())
            self.n += n
            if self.raw is not None:
                self.raw += map(int, ids.split())


class WordBpe:
    """The tokenizer file's pipeline: special tokens, normalisation, words, bytes, merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.letters = byte_letters()
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.machine = Transducer(self.ids, merges, model["end_of_word_suffix"] or "")
        self.machine.prepare(self.back)
        self.number = [str(self.ids[t]) for t in self.machine.names]
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.word_memo: dict[bytes, tuple[int, str, str]] = {}
        self.word_old: dict[bytes, tuple[int, str, str]] = {}
        self.joined = regex.compile(pattern + r"|\n")

    def normal(self, text: str) -> str:
        # Each character is lowered by itself: no final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words_of(self, chunk: str) -> list[bytes]:
        """Words of one piece, by the library's own normalisation and word cutting: Python's tables are of another
        Unicode version, and its white space has the separators U+001C to U+001F."""
        return [bytes([self.back[c] for c in w]) for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def learn(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """Encodes pieces without white space: number of tokens, ids and strings, each joined by one space."""
        text = "\n".join(chunks)
        if max(text, default="") < "\u0500" and not _ODD.search(text):
            plain, other = chunks, []
        else:
            plain = [c for c in chunks if max(c) < "\u0500" and not _ODD.search(c)]
            other = list(set(chunks).difference(plain))
            text = "\n".join(plain)
        found, row = [], []
        if plain:
            for w in self.joined.findall(self.normal(text) + "\n"):
                if w == "\n":
                    found.append(row)
                    row = []
                else:
                    row.append(w.encode("utf-8"))
        pieces = [*zip(plain, found), *((c, self.words_of(c)) for c in other)]
        index: dict[bytes, int] = {}
        todo = [(c, [index.setdefault(w, len(index)) for w in ws]) for c, ws in pieces]
        # Pieces differ by signs and capitals more than by words, which have a memory of their own.
        if len(self.word_memo) > MEMO:
            self.word_old, self.word_memo = self.word_memo, {}
        memo, old = self.word_memo, self.word_old
        parts = []
        new = []
        for i, w in enumerate(index):
            part = memo.get(w)
            if part is None:
                part = old.get(w)
                if part is None:
                    new.append((i, w))
                else:
                    memo[w] = part
            parts.append(part)
        coded = self.machine.encode_words([w for _, w in new if len(w) <= Transducer.LONG])
        at = iter(coded)
        number, names = self.number, self.machine.names
        for i, w in new:
            if len(w) <= Transducer.LONG:
                t = next(at)
                parts[i] = memo[w] = (len(t), " ".join([number[k] for k in t]), " ".join([names[k] for k in t]))
            else:
                t = self.machine.encode_word("".join([self.letters[b] for b in w]))
                parts[i] = (len(t), " ".join([str(self.ids[x]) for x in t]), " ".join(t))
        out = {}
        for c, at in todo:
            if len(at) == 1:
                out[c] = parts[at[0]]
            elif len(at) == 2:
                (n, a, x), (m, b, y) = parts[at[0]], parts[at[1]]
                out[c] = (n + m, f"{a} {b}", f"{x} {y}")
            elif at:
                counts, ids, toks = zip(*[parts[i] for i in at])
                out[c] = (sum(counts), " ".join(ids), " ".join(toks))
            else:
                out[c] = (0, "", "")
        return out

    def split(self, text: str) -> list[str]:
        return _PIECE.findall(text) if _ODD.search(text) else text.split()

    def segments(self, text: str) -> Iterable[str]:
        """The text in order, cut before white space."""
        at = 0
        while at < len(text):
            end = at + SEGMENT
            if end < len(text):
                end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                if end < 0:
                    found = _SPACE.search(text, at + SEGMENT)
                    end = found.start() if found else len(text)
            yield text[at:end] if at or end < len(text) else text
            at = end

    def encode_window(self, segments: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids and strings (each joined by one blank) of each segment."""
        rows = []
        for text in segments:
            row, at = [], 0
            for mark in [*(self.cut.finditer(text) if "<|" in text else ()), None]:
                row.append(self.split(text[at : mark.start() if mark else len(text)]))
                if mark:
                    row.append(mark[0])
                    at = mark.end()
            rows.append(row)
        # Two generations: what is met again moves to the young one, so a full table forgets only rare pieces.
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        new = set().union(*[part for row in rows for part in row if isinstance(part, list)]).difference(memo)
        known = new & old.keys()
        memo.update({c: old[c] for c in known})
        new -= known
        memo.update(self.learn(list(new)) if new else {})
        long = [c for c in new if len(c) >= Transducer.LONG]
        out = []
        for row in rows:
            got: list[tuple[int, str, str]] = []
            for part in row:
                if isinstance(part, list):
                    got += map(memo.__getitem__, part)
                else:
                    got.append((1, str(self.special[part]), part))
            if got:
                counts, ids, names = zip(*got)
                if 0 in counts:
                    got = [g for g in got if g[0]]
                    counts, ids, names = zip(*got) if got else ((), (), ())
                out.append((sum(counts), " ".join(ids), " ".join(names)))
            else:
                out.append((0, "", ""))
        for c in long:
            del memo[c]
        return out

    def encode_many(self, texts: Iterable[str], with_ids: bool = False) -> list[Encoding]:
        out: list[Encoding] = []
        window: list[tuple[Encoding, str]] = []
        size = 0

        def flush():
            for (to, _), got in zip(window, self.encode_window([x for _, x in window])):
                to.add(*got)
            window.clear()

        for text in texts:
            out.append(Encoding(with_ids))
            for segment in self.segments(text):
                window.append((out[-1], segment))
                size += len(segment)
                if size >= WINDOW:
                    flush()
                    size = 0
        flush()
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids and strings of a text, whole."""
        got = [self.encode_window([x])[0] for x in self.segments(text)]
        counts, ids, names = zip(*[g for g in got if g[0]]) if any(g[0] for g in got) else ((), (), ())
        return sum(counts), " ".join(ids), " ".join(names)

    def to_text(self, tokens: Iterable[str]) -> str:
        """Token strings back to normalised text."""
        machine = TextDecoder(self.back, self.machine.end)
        return "".join([*map(machine.push, tokens), machine.close()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    out = WordBpe(path)
    # What reading the file took goes back to the system, with what an earlier stage left in a reused worker.
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return out


def bpe_encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and with ``with_ids`` the ids) of every whole text."""
    small_batches(docs.sparkSession)
    where = path or default_path()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(where)

        def encoded(held):
            texts = (x.as_py().decode("utf-8", "replace") if x.is_valid else "" for batch in held for x in batch.column(1))
            got = bpe.encode_many(texts, with_ids)
            doc_ids = pa.chunked_array([batch.column(0).cast(pa.int64()) for batch in held]).combine_chunks()
            cols = [doc_ids, pa.array([e.n for e in got], pa.int64()), *(pa.array([d.hexdigest() for d in x], pa.string()) for x in ([e.ids for e in got], [e.decoded for e in got]))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array([e.raw for e in got], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        # The memories hold a million small tuples and no cycles, which a collector would walk through again and again.
        gc.disable()
        try:
            # Words of several batches run in lockstep together, up to a window's worth of bytes.
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size >= WINDOW:
                    yield encoded(held)
                    held, size = [], 0
            if held:
                yield encoded(held)
        finally:
            gc.enable()

    src = clean_columns(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("t"))
    return src.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text``: the normalised text that the ``ids`` of each row stand for (null ids: empty)."""
    where = path or default_path()

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(where)
        name = {i: t for t, i in (bpe.ids | bpe.special).items()}
        for batch in batches:
            special = set(bpe.special.values())
            texts = []
            for ids in batch.column(1).to_pylist():
                machine, out = TextDecoder(bpe.back, bpe.machine.end), []
                for i in ids or ():
                    out.append(f"{machine.close()}{name[i]}" if i in special else machine.push(name[i]))
                texts.append("".join([*out, machine.close()]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return clean_columns(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read(spark, sf_dir, "documents"))
