"""BPE encoding by prefix-sharing trie traversal, and decoding, for a word tokenizer file with word ends.

A task gathers the distinct words of a batch as a trie (sorted words; neighbours share the path to their common prefix)
and walks it depth first. The state of a node is the last token of its prefix's encoding: among the tokens that end
there it is the one that may follow the state it leaves behind, so a prefix shared by many words is encoded once, and a
word's encoding is read back along the states. Two tokens may stand side by side when no merge across their border would
have come before the merges that built them.

Encoded words are kept per task in a bounded table. Normalisation: NFC, lower case, the file's split pattern. A
text with a code point that this Python's character database does not know is normalised by the tokenizers library itself,
since the two may know different Unicode versions. Decoding looks ids up in a table of token texts, in the JVM.

Defined cases: null and empty text give no ids; no ids give the empty text; strings of added tokens are those tokens;
repeated rows are encoded each; no rows give no rows; a column named like the result is replaced."""

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Entries of the tables that a task keeps (words, and pairs of tokens); a full table is started anew.
KEPT_WORDS, KEPT_PAIRS = 100_000, 250_000
#: Characters of the texts whose words are gathered at once; a longer text stands alone.
BLOCK_CHARS = 2_000_000
# fixed values: the split pattern of the word BPE, and forms of it that match the same and faster
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9]+", re.ASCII)
_OTHER = regex.compile(r"\p{L}+|\p{N}|'(?:[stmd]|re|ve|ll)|[^\s\p{L}\p{N}]+")
_END = "\n"  # stands for the word end; no symbol of a word
_FOREVER = sys.maxsize


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, free = {b: chr(b) for b in shown}, iter(range(256, 512))
    return [symbols.get(b) or chr(next(free)) for b in range(256)]


class WordBpe:
    """A tokenizer file (its JSON text) of kind BPE with an end-of-word suffix and byte symbols."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a word BPE file with plain added tokens is expected")
        self._definition = definition
        key = lambda token: token.removesuffix(suffix) + _END * token.endswith(suffix)
        self.vocabulary: dict[str, int] = model["vocab"]
        self.texts = {i: t for t, i in self.vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: np.int32(t["id"]).tobytes() for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._ascii, self._other = (_ASCII, _OTHER) if split == _PATTERN else (regex.compile(split),) * 2
        self._bytes = dict(enumerate(_byte_symbols()))
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left part, right part
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]
            self.pairs[left, right] = rank
            self.made[whole] = (rank, left, right)
        self.tokens = {key(t): i for t, i in self.vocabulary.items() if i not in self.made or self.apart_inside(i)}
        self._build_suffixes()
        self._beside: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._library = None

    def apart_inside(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token: its two parts must come about unhindered."""
        _, left, right = self.made[token]
        return self._may_meet(left, right, self.made[token][0])

    def _may_meet(self, left: int, right: int, limit: int = _FOREVER) -> bool:
        """Whether no merge across the border of two tokens fires before both are complete (or before `limit`).

        Goes back in time: of the tokens at the border the one made later is undone, until both are single symbols.
        Between equal merges the one to the left comes first."""
        left_until = right_until = limit
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < left_until and across <= right_until and across < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                left_until, left = a[0], a[2]
            else:
                right_until, right = b[0], b[1]

    def beside(self, left: int, right: int) -> bool:
        known = self._beside.get(left << 32 | right)
        if known is None:
            if len(self._beside) >= KEPT_PAIRS:
                self._beside.clear()
            known = self._beside[left << 32 | right] = self._may_meet(left, right)
        return known

    def _build_suffixes(self) -> None:
        """An automaton over the token texts whose state knows all tokens that end where it stands, longest first."""
        self._next: list[dict[str, int]] = [{}]
        here: list[tuple[int, int] | None] = [None]
        for text, token in self.tokens.items():
            state = 0
            for symbol in text:
                state = self._next[state].setdefault(symbol, len(self._next))
                if state == len(self._next):
                    self._next.append({})
                    here.append(None)
            here[state] = (token, len(text) - text.endswith(_END))
        self._shorter = [0] * len(here)  # the state of the longest proper ending
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(here)
        self._moves: dict[int, int] = {}
        queue = [0]
        for state in queue:
            for symbol, after in self._next[state].items():
                queue.append(after)
                self._shorter[after] = self._step(self._shorter[state], symbol) if state else 0
                own = here[after]
                self.ending[after] = ((own,) if own else ()) + self.ending[self._shorter[after]]

    def _step(self, state: int, symbol: str) -> int:
        while symbol not in self._next[state]:
            if not state:
                return 0
            state = self._shorter[state]
        return self._next[state][symbol]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encodings of distinct words of byte symbols. Sorted words walk their trie depth first."""
        out, before = {}, ""
        last, sizes, states = [-1], [0], [0]  # per prefix length: last token, its symbols, state of the token endings
        ending, moves, beside, get = self.ending, self._moves, self.beside, self._beside.get
        for word in sorted(words):
            length = len(word)
            shared, most = 0, min(len(before), length - 1, len(states) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], sizes[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for at in range(shared, length):
                symbol = word[at]
                after = moves.get(state << 10 | ord(symbol))
                if after is None:
                    if len(moves) >= KEPT_PAIRS:
                        moves.clear()
                    after = moves[state << 10 | ord(symbol)] = self._step(state, symbol)
                state = after
                for token, size in ending[self._step(state, _END) if at + 1 == length else state]:
                    if size > at:
                        break
                    left = last[at + 1 - size]
                    known = get(left << 32 | token)
                    if known or (known is None and beside(left, token)):
                        break
                last.append(token)
                sizes.append(size)
                states.append(state)
            ids, at = [], length
            while at:
                ids.append(last[at])
                at -= sizes[at]
            # the last symbol carries the word end and is no prefix of another word
            last.pop(), sizes.pop(), states.pop()
            ids.reverse()
            out[word], before = ids, word
        return out

    def _split(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        if text.isascii():
            return self._ascii.findall(text.lower())
        if not self._strange(text):
            normal = unicodedata.normalize("NFC", text)
            # letter by letter: the lower case of a sigma does not depend on its place
            return self._other.findall("".join(map(str.lower, normal)) if "Σ" in normal else normal.lower())
        lib = self._tokenizers()
        normal = lib.normalizer.normalize_str(text)
        back = {s: b for b, s in self._bytes.items()}
        return [bytes(back[c] for c in p).decode() for p, _ in lib.pre_tokenizer.pre_tokenize_str(normal)]

    @staticmethod
    def _strange(text: str) -> bool:
        """Whether the text has a code point that is unassigned in this Python's character database."""
        return any(unicodedata.category(c) == "Cn" for c in set(text))

    def _tokenizers(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._definition)
        return self._library

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The table of words is tested before every block of texts, so it holds what one block adds beyond its limit."""
        out: list[np.ndarray] = []
        first, size = 0, 0
        for at, text in enumerate(texts):
            if size and size + len(text) > BLOCK_CHARS:
                out += self._encode_block(texts[first:at])
                first, size = at, 0
            size += len(text)
        return out + self._encode_block(texts[first:])

    def _encode_block(self, texts: list[str]) -> list[np.ndarray]:
        words = []
        for text in texts:
            if any(token in text for token in self.added):
                parts = enumerate(self._cut.split(text))
                words.append(list(chain.from_iterable((p,) if i % 2 else self._split(p) for i, p in parts)))
            else:
                words.append(self._split(text))
        known = self._known
        if len(known) > KEPT_WORDS or not known:
            known.clear()
            known.update(self.added)  # no word of the pattern reads like an added token
        fresh = {w: "".join(map(self._bytes.__getitem__, w.encode())) for w in set(chain.from_iterable(words)) - known.keys()}
        encoded = self.encode_words(fresh.values())
        for word, symbols in fresh.items():
            known[word] = array("i", encoded[symbols]).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, w)), np.int32) for w in words]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as a file without a decoder does; unknown ids are left out."""
        return " ".join([t for t in map(self.texts.get, ids) if t is not None])


def encode_documents(docs: DataFrame, definition: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids (array of int) of every text. `definition` is the JSON text of the tokenizer file, some MB at most."""
    kept = docs.drop(ids)
    sent, at = docs.sparkSession.sparkContext.broadcast(definition), kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(sent.value)  # not kept between tasks: a worker goes on to stages that need its memory
        for batch in batches:
            coded = bpe.encode([t or "" for t in batch.column(at).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *coded])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[*batch.schema.names, ids]
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_documents(docs: DataFrame, definition: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids, as a file without a decoder reads: token texts joined by spaces.

    Null ids read as none, unknown ids are left out. The table of token texts is one constant of the plan."""
    spec = json.loads(definition)
    texts = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    mark = "\x01"  # in no token
    table = F.split(F.lit(mark.join(texts.get(i, "") for i in range(max(texts) + 1))), mark)
    known = F.filter(F.transform(F.col(ids), lambda i: F.get(table, i)), lambda t: t != "")
    return docs.withColumn(text, F.coalesce(F.array_join(known, " "), F.lit("")))
