"""Secret scan: Aho-Corasick keyword prefilter, regular expressions anchored at its hits, embedded checksums last.

All rules' keywords form one automaton that reads each whole text once (A-Z lowered). A rule's pattern is tried only where
one of its keywords begins, and never inside the rule's previous match, which gives the leftmost matches in turn. Rules
whose tokens carry a checksum keep a match only if the checksum holds.

Rules of the base kinds have none: `assign` (a named value), `access` (key ids) and `hex` (long hexadecimal runs, found
by the three-digit runs inside them). The other kinds are tokens with a CRC-32 in base 62, Bech32 and Base58Check keys.

Texts stay in their rows and partitions: one narrow pass, no shuffle, memory for one batch of texts and the hits of one text.

Defined cases: a null or empty text has no spans (redacted: null stays null); places are code points, ends exclusive;
spans of different kinds may overlap, those of one kind never do; repeated rows are scanned each; no rows give no rows;
extra columns are kept, one named like a result is replaced."""

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"  # fixed: digits of base 62 in token checksums
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"  # fixed: the Base58 alphabet
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"  # fixed: the Bech32 alphabet
_BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)  # fixed: the generator of its checksum


def crc_base62(token: str) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, in base 62."""
    body, value = token[-36:-6], 0
    for c in token[-6:]:
        value = value * 62 + _LETTERS.index(c)
    return zlib.crc32(body.encode()) == value


def base58check(token: str) -> bool:
    """The last four of the encoded bytes are the first four of the double SHA-256 of the rest."""
    value = 0
    for c in token:
        value = value * 58 + _BASE58.index(c)
    data = bytes(len(token) - len(token.lstrip("1"))) + value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(data) > 4 and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32(token: str) -> bool:
    """The polynomial of prefix and data leaves 1."""
    prefix, data = token.lower().rsplit("1", 1)
    state = 1
    for value in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(_BECH32.index, data)]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ value
        for bit, step in enumerate(_BECH32_STEPS):
            if top >> bit & 1:
                state ^= step
    return state == 1


class Rule(NamedTuple):
    """One kind of secret. Every match of `pattern` begins with a keyword (A-Z lowered); `group` must have `least` characters."""

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    checksum: Callable[[str], bool] | None = None


# fixed values: the kinds in their order, with their patterns
BASE_RULES = (
    Rule(
        "assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True,
    ),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", tuple(map("".join, product("0123456789abcdef", repeat=3))), r"[0-9a-f]+", 0, 24),
)
CHECKED_RULES = (
    Rule("code_host", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", checksum=crc_base62),
    Rule("package_host", ("npm_",), r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", checksum=crc_base62),
    Rule("age_key", ("age-secret-key-1",), r"AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}(?![A-Z0-9])", checksum=bech32),
    Rule("extended_key", ("xprv",), r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])", checksum=base58check),
)
RULES = BASE_RULES + CHECKED_RULES


class Scanner:
    """The automaton of all keywords and the rules that wait at their hits."""

    def __init__(self, rules: tuple[Rule, ...]):
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)).match) for r in rules]
        waiting: dict[str, list[int]] = {}
        for at, rule in enumerate(rules):
            for word in rule.keywords:
                waiting.setdefault(word, []).append(at)
        self._automaton = ahocorasick.Automaton()
        for word, ats in waiting.items():
            self._automaton.add_word(word, (len(word) - 1, tuple(ats)))
        if waiting:
            self._automaton.make_automaton()
        self._any = bool(waiting)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every secret, by start, then in the order of the rules."""
        if not text or not self._any:
            return []
        # lowering the bytes touches A-Z alone and moves no place
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits: list[list[int]] = [[] for _ in self.rules]
        for end, (back, ats) in self._automaton.iter(low):
            for at in ats:
                hits[at].append(end - back)
        found = []
        for at, (rule, match) in enumerate(self.rules):
            starts = hits[at] if len({len(w) for w in rule.keywords}) == 1 else sorted(hits[at])
            done = 0
            for start in starts:
                if start >= done and (m := match(text, start)):
                    done = m.end()
                    if done - start < rule.least or (rule.group and m.end(rule.group) - m.start(rule.group) < rule.least):
                        continue
                    if rule.checksum is None or rule.checksum(m.group()):
                        found.append((start, at, done))
        return [(start, end, self.rules[at][0].kind) for start, at, end in sorted(found)]


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by the kinds found there in brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kinds = spans[i][0], spans[i][1], [spans[i][2]]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end, kinds = max(end, spans[i][1]), kinds + [spans[i][2]] * (spans[i][2] not in kinds)
            i += 1
        out += [text[at:start], "[" + "+".join(kinds) + "]"]
        at = end
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """Adds the spans of all secrets in each whole text, and with `redacted` a column with the text without them."""
    kept = docs.drop(spans, *([redacted] if redacted else []))
    at = kept.columns.index(text)
    fields = [T.StructField(spans, SPANS), *([T.StructField(redacted, T.StringType())] if redacted else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found, clean = [], []
            for value in batch.column(at):
                own = value.as_py()
                hits = scanner.spans(own)
                found.append([{"kind": k, "start": s, "end": e} for s, e, k in hits])
                if redacted:
                    clean.append(redact(own, hits))
            added = [pa.array(found, kind), *([pa.array(clean, pa.string())] if redacted else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[f.name for f in fields]])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
