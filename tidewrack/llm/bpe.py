"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

Encoding rests on a property of merge lists: a sequence of tokens is the
encoding of its text exactly when each two neighbours are, on their own, the
encoding of theirs. So for every prefix of a word one last token is right, and
it is found among the tokens that end there by looking at the right last token
where each begins. The transducer keeps these links for the prefixes that a
later token can still begin at: as many as the longest token has symbols, the
merge list's sufficient lookahead. A token is emitted once all those prefixes'
chains pass through it, so a word of any length takes bounded memory.

Decoding is incremental too: tokens become bytes, and bytes become text as soon
as they complete a character. The library's own decoding of a file without a
decoder, the names of the tokens, comes out of the same machine. Memory doesn't
grow with a text but for the text itself: ids are handed on in chunks, and what
is remembered of words, pairs and prefixes is bounded.

Defined results: a null or empty text has no tokens; whole texts are encoded
whatever their length. Special tokens in a text become their ids, as the
tokenizer file says; lone surrogates count as U+FFFD. Rows are encoded each by
itself, also those with a null or repeated id.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts

END = "\ue000"  # stands for the word-end mark; byte-level text never has it
WORDS_KEPT, PAIRS_KEPT, HEADS_KEPT, HEAD = 300_000, 400_000, 100_000, 5
#: Ids handed on at once, and the characters from which a text's words aren't listed.
CHUNK, LONG = 4096, 1 << 18
_LOADED: dict[str, Tokenizer] = {}


def byte_alphabet() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge list, with what the transducer asks of it. Tokens are strings in the byte alphabet."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocab = vocab
        #: In symbols; a word-end mark belongs to its symbol. No token that begins earlier can still grow.
        self.lookahead = max((len(t.replace(END, "")) for t in vocab), default=1)
        self.parts = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        #: A token that several merges make has no one history; fits() then goes back to the definition.
        self.one_way = len(self.parts) == len(self.rank)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._heads: dict[str, tuple[str, ...]] = {}
        #: Starts to try for the last token that ends at a place. One is right: most often where the one before begins, or the new symbol alone.
        self._orders = [[tuple(dict.fromkeys((before, at - 1, *range(at)))) for before in range(at)] for at in range(self.lookahead + 1)]

    def direct(self, symbols: list[str]) -> list[str]:
        """Encode by applying the lowest-ranked merge again and again: the definition, used on tokens and pairs only."""
        symbols = list(symbols)
        rank, worst = self.rank, len(self.rank)
        while len(symbols) > 1:
            best = min(zip(symbols[:-1], symbols[1:], strict=True), key=lambda p: rank.get(p, worst))
            if best not in rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def whole(self, token: str) -> bool:
        """Whether a token's text is encoded as that token."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = self.direct(_symbols(token)) == [token]
        return got

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are the encoding of their text."""
        got = self._pairs.get((left, right))
        if got is None:
            if len(self._pairs) > PAIRS_KEPT:
                self._pairs.clear()
            got = self._apart(left, right) if self.one_way else self.direct(_symbols(left) + _symbols(right)) == [left, right]
            self._pairs[left, right] = got
        return got

    def _apart(self, left: str, right: str) -> bool:
        """Go back in time through the pieces on either side of the border: did ever a merge join two of them?

        A piece lives from the merge that makes it to the one that uses it. A
        merge across the border happens if it comes before both pieces are
        used; merges of one rank go from left to right.
        """
        rank, parts, none = self.rank, self.parts, (-1, "", "")
        left_used = right_used = len(rank)
        while True:
            across = rank.get((left, right))
            if across is not None and across < left_used and across <= right_used:
                return False
            a, b = parts.get(left, none), parts.get(right, none)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                left_used, left = a[0], a[2]
            else:
                right_used, right = b[0], b[1]

    def last(self, text: str, at: int, end: int, links: dict[int, str | None]) -> str:
        """The right last token of the prefix that ends at end; at: where text's own first symbol is."""
        vocab, pairs, known = self.vocab, self._pairs, self._whole
        text = text[: end - at]
        for start in range(max(at, end - self.lookahead - 1), end):
            token = text[start - at :]
            if token in vocab and start in links:
                ok = known.get(token)
                if ok is None:
                    ok = self.whole(token)
                if ok:
                    before = links[start]
                    if before is None:
                        return token
                    ok = pairs.get((before, token))
                    if ok is None:
                        ok = self.fits(before, token)
                    if ok:
                        return token
        raise ValueError("no symbol of the vocabulary fits")

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each as soon as it is stable. Of the word, only what is not yet emitted is kept."""
        text, at, end = "", 0, 0
        links: dict[int, str | None] = {0: None}
        done, since = 0, 0
        for s in symbols:
            text += s
            end += len(s)
            links[end] = self.last(text, at, end, links)
            since += 1
            if since > 2 * self.lookahead:
                since = 0
                live = [p for p in links if p >= end - self.lookahead - 1]
                stable = self._meet(links, live, done)
                yield from self._chain(links, stable, done)
                done = stable
                keep = min(done, min(live))
                text, at = text[keep - at :], keep
                links = {p: t for p, t in links.items() if p >= keep}
        yield from self._chain(links, end, done)

    def short(self, text: str, n: int) -> list[str]:
        """The same for a word of n symbols within the lookahead: all prefixes stay live, so a list does. The last symbol may have a mark.

        The right last tokens of a prefix are the same in every word that begins
        with it; those of the first HEAD symbols are remembered.
        """
        vocab, pairs, known, orders = self.vocab, self._pairs, self._whole, self._orders
        links = self._heads.get(text[:HEAD]) if n > HEAD else None
        at = HEAD if links else 0
        links = [*links, *[""] * (n - HEAD)] if links else [""] * (n + 1)
        # Where the last token begins.
        before = at - len(links[at])
        while at < n:
            at += 1
            head = text[:at] if at < n else text
            for start in orders[at][before]:
                token = head[start:]
                if token in vocab and (known[token] if token in known else self.whole(token)):
                    if not start:
                        break
                    pair = (links[start], token)
                    if pairs[pair] if pair in pairs else self.fits(*pair):
                        break
            else:
                raise ValueError("no symbol of the vocabulary fits")
            links[at], before = token, start
            if at == HEAD < n:
                if len(self._heads) > HEADS_KEPT:
                    self._heads.clear()
                self._heads[head] = tuple(links[: HEAD + 1])
        out = []
        while at:
            token = links[at]
            out.append(token)
            at -= len(token) - (token[-1] == END)
        return out[::-1]

    def _meet(self, links: dict[int, str | None], live: list[int], done: int) -> int:
        """The last position that the chains of all live prefixes pass through."""
        heads = set(live)
        while len(heads) > 1:
            p = max(heads)
            heads.remove(p)
            heads.add(max(done, p - len(links[p])))
        return heads.pop()

    def _chain(self, links: dict[int, str | None], end: int, done: int) -> list[str]:
        out = []
        while end > done:
            out.append(links[end])
            end -= len(links[end])
        return out[::-1]


def _symbols(token: str) -> list[str]:
    """Single symbols of a token; a word-end mark stays with the last one."""
    s = list(token)
    return [*s[:-2], s[-2] + s[-1]] if s[-1] == END else s


class Tokenizer:
    """Encoder and decoder of a tokenizer file with byte-level BPE and a word-end mark."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        inner = lambda t: t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) else t
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.vocab = {inner(t): i for t, i in model["vocab"].items() if t not in special}
        self.merges = Merges(((inner(a), inner(b)) for a, b in model["merges"]), self.vocab)
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        self.special = special
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # Python's \s also takes U+001C to U+001F, which aren't white space in Unicode's list.
        space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.pretoken = regex.compile(pattern.replace("[^\\s", f"[^{space}"))
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bytes = byte_alphabet()
        self.unbytes = {c: b for b, c in self.bytes.items()}
        ends = lambda t: bool(self.suffix) and t.endswith(self.suffix)
        self.special_ids = frozenset(special.values())
        #: What each token's name says; a word end is a space.
        self.token_bytes = {i: bytes(self.unbytes[c] for c in (t[: -len(self.suffix)] if ends(t) else t)) + b" " * ends(t) for i, t in self.names.items() if i not in self.special_ids}
        self._words = _Words(self)

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Each character is lowered by itself, so a sigma at the end of a word is no special case.
            return text.replace("Σ", "σ").lower()
        return text.lower()

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.bytes[b] for b in word.encode("utf-8", "replace")]
        if self.suffix:
            symbols[-1] += END
        tokens = self.merges.short("".join(symbols), len(symbols)) if len(symbols) <= self.merges.lookahead else self.merges.stream(symbols)
        return [self.vocab[t] for t in tokens]

    def chunks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text in lists of about CHUNK, as soon as they are known."""
        out: list[int] = []
        if not text.isascii():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        parts = self.special_re.split(text) if self.special_re and "<|" in text else [text]
        words = self._words
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = self.normalize(part)
            # A short text's words fit in a list; those of a long one come one by one.
            found = self.pretoken.findall(part) if len(part) <= LONG else (m[0] for m in self.pretoken.finditer(part))
            for w in found:
                out += words[w]
                if len(out) >= CHUNK:
                    yield out
                    out = []
        if out:
            yield out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.chunks(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """As the tokenizers library does for a file without a decoder: the tokens' names, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as soon as their bytes are complete; a word end becomes a space, bad bytes U+FFFD."""
        decoder = Decoder(self)
        ids = iter(ids)
        while some := list(islice(ids, CHUNK)):
            yield decoder.feed(some)[1]
        yield decoder.end()


class Decoder:
    """The incremental decoder: tokens in, at any cut, and out both what the library calls decoded and the text that their bytes say.

    Its state is whether a token came before and at most three bytes of an
    unfinished character. A word end becomes a space, bad bytes U+FFFD; a
    special token ends what is unfinished and stands for its name.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.names, self.bytes, self.special = tokenizer.names, tokenizer.token_bytes, tokenizer.special_ids
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.joint = ""

    def feed(self, ids: list[int]) -> tuple[str, str]:
        if not ids:
            return "", ""
        names = self.joint + " ".join(map(self.names.__getitem__, ids))
        self.joint = " "
        if self.special.isdisjoint(ids):
            return names, self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))
        out = []
        for i in ids:
            if i in self.special:
                out += [self.state.decode(b"", True), self.names[i]]
                self.state.reset()
            else:
                out.append(self.state.decode(self.bytes[i]))
        return names, "".join(out)

    def end(self) -> str:
        return self.state.decode(b"", True)


class _Words(dict):
    """Ids of words seen, so that a frequent word is encoded once.

    With WORDS_KEPT words it becomes the older of two generations, and the one
    before goes; a word met again in the older one moves to the younger.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.older = tokenizer, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.tokenizer.word(word)
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, read once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""

    def make():
        t = tokenizer(path)
        return lambda texts: [[t.encode(x) for x in texts]]

    return map_texts(docs, id_col, text_col, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: what the ids say, by the incremental decoder. Null ids give null."""
    fields = [T.StructField("text", T.StringType())]

    def make():
        t = tokenizer(path)
        return lambda _, ids: [["".join(t.text(x)) if x is not None else None for x in ids]]

    return map_texts(encoded.withColumn("_none", F.lit("")), id_col, "_none", make, fields, (ids_col,))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids, of what they decode to as the library says it, and of the text that their bytes say; with_ids also the ids.

    A text streams through: each chunk of ids is decoded and digested, and then forgotten.
    """
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("ids_sha256", "decoded_sha256", "text_sha256")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]

    def make():
        t = tokenizer(path)
        numbers = {i: str(i) for i in t.names}

        def f(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in fields]
            for text in texts:
                n, every, decoder = 0, [], Decoder(t)
                of_ids, of_names, of_text = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                for ids in t.chunks(text):
                    of_ids.update((" " * (n > 0) + " ".join(map(numbers.__getitem__, ids))).encode())
                    names, said = decoder.feed(ids)
                    of_names.update(names.encode("utf-8"))
                    of_text.update(said.encode("utf-8"))
                    n += len(ids)
                    if with_ids:
                        every += ids
                of_text.update(decoder.end().encode("utf-8"))
                for column, x in zip(out, (n, of_ids.hexdigest(), of_names.hexdigest(), of_text.hexdigest(), every), strict=False):
                    column.append(x)
            return out

        return f

    return map_texts(docs, id_col, text_col, make, fields)
