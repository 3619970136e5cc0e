"""Secret scans over a trigram inverted index.

Each rule's regular expression is parsed once into a Boolean query over case-folded trigrams that every match must
hold. A task builds, for each Arrow batch of documents, an inverted index (trigram -> ordinals of the documents that
hold it), combines the posting lists as the query says, and runs the expression only over the candidates. A rule without
mandatory trigrams scans every text. Index and postings are bounded by a batch, so nothing is shuffled and a lost
executor costs its tasks alone.

Defined cases: a null text counts as empty; an empty text has no spans and the digest of an empty string; a null doc_id is
passed on; repeated rows are scanned as often as they occur; other columns of the input are ignored. Texts of any
length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

try:
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # before Python 3.11
    import sre_constants as rc
    import sre_parse as rp

from tagloom.runtime import ship, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and least: the group whose length decides, and how many characters it needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The expressions that the task gives for its base kinds.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Publicly documented shapes of issued tokens and keys.
ISSUED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + ISSUED_RULES

#: A query is None (every document), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
MOST_STRINGS = 64


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    flat: list[Query] = []
    for p in parts:
        if p is not None and p not in flat:
            flat.append(p)
    return None if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> Query:
    """Any of the strings, each as all of its trigrams."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _chars(op, arg) -> set[str] | None:
    """The folded characters that one position may hold, if they are few and ASCII."""
    if op is rc.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is not rc.IN:
        return None
    out: set[str] = set()
    for o, a in arg:
        if o is rc.LITERAL:
            out.add(chr(a).lower())
        elif o is rc.RANGE and a[1] - a[0] < 16:
            out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
        else:
            return None
        if len(out) > 8 or any(ord(c[0]) > 127 for c in out):
            return None
    return out


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """The exact strings that the parsed expression matches, if they are few, and what every match must hold."""
    exact: set[str] | None = {""}
    needs: list[Query] = []

    def flush() -> None:
        nonlocal exact
        if exact is not None:
            needs.append(_of_strings(exact))
        exact = {""}

    def append(strings: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            flush()
        exact = {a + b for a in exact for b in strings}

    for op, arg in parsed:
        if (chars := _chars(op, arg)) is not None:
            append(chars)
        elif op is rc.SUBPATTERN or op is rc.BRANCH:
            inner = [arg[3]] if op is rc.SUBPATTERN else arg[1]
            found = [_walk(x) for x in inner]
            if all(e is not None for e, _ in found) and len(strings := set().union(*(e for e, _ in found))) <= MOST_STRINGS:
                append(strings)
            else:
                flush()
                needs.append(_both("or", [q for _, q in found]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            strings, need = _walk(inner)
            if strings is not None and high <= 2:
                append({"".join(x) for n in range(low, high + 1) for x in [[s] * n for s in strings]} if len(strings) == 1 else strings | ({""} if low == 0 else set()) if high == 1 else {""})
                if len(strings) > 1 and high > 1:
                    flush()
            else:
                flush()
                if low:
                    needs.append(need)
        elif op is not rc.AT:
            flush()
    if needs == [] and exact is not None:
        return exact, _of_strings(exact)
    flush()
    return None, _both("and", needs)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over case-folded ASCII trigrams that every text with a match satisfies; None: no constraint."""
    return _walk(rp.parse(pattern))[1]


def _trigrams(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


@dataclass
class Scanner:
    """Compiled rules with their queries and the table of trigrams that any query asks for."""

    rules: tuple[Rule, ...] = RULES
    compiled: list = field(init=False)
    queries: list = field(init=False)

    def __post_init__(self) -> None:
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        self.queries = [trigram_query(r.pattern) for r in self.rules]
        self.ids = {t: i for i, t in enumerate(sorted(set().union(*map(_trigrams, self.queries))), 1)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.ids.items():
            a, b, c = t.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, column: pa.StringArray) -> dict[str, np.ndarray]:
        """The inverted index of a batch: for each trigram in question the sorted ordinals of the texts that hold it."""
        column = column.fill_null("") if column.null_count else column
        wide = pa.types.is_large_string(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        if len(offsets) == 0 or column.buffers()[2] is None:
            return {}
        data = np.frombuffer(column.buffers()[2], np.uint8)
        ordinals, ids = [], []
        step = 1 << 22
        for lo in range(int(offsets[0]), int(offsets[-1]), step):
            part = self.fold[data[lo : min(lo + step + 2, int(offsets[-1]))]].astype(np.uint32)
            if len(part) < 3:
                break
            got = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(got)
            doc = np.searchsorted(offsets, at + lo, side="right") - 1
            inside = at + lo + 3 <= offsets[doc + 1]
            pair = np.unique(got[at[inside]].astype(np.int64) << 32 | doc[inside])
            ids.append(pair >> 32)
            ordinals.append(pair & 0xFFFFFFFF)
        if not ids:
            return {}
        pair = np.unique(np.concatenate(ids) << 32 | np.concatenate(ordinals))
        cut = np.searchsorted(pair >> 32, np.arange(1, len(self.ids) + 2))
        return {t: pair[cut[i - 1] : cut[i]] & 0xFFFFFFFF for t, i in self.ids.items()}

    def candidates(self, query: Query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
        """Posting lists combined as the query says."""
        if query is None:
            return np.arange(n)
        if isinstance(query, str):
            return index.get(query, np.empty(0, np.int64))
        lists = [self.candidates(q, index, n) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out

    def spans(self, column: pa.StringArray) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), sorted; code points, end exclusive."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        index = self.postings(column)
        texts = column.to_pylist()
        for k, (rule, compiled, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            # a run of one class: asking for its length at once finds the same matches
            fast = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}") if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else compiled
            for i in self.candidates(query, index, len(texts)).tolist():
                if text := texts[i]:
                    for m in fast.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), k, m.end()))
        for x in found:
            x.sort()
        return found


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) for every row; spans by start, then in the order of the rules."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in batches:
            spans = [[{"kind": rules[k].kind, "start": lo, "end": hi} for lo, k, hi in x] for x in s.spans(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{kind}]") -> DataFrame:
    """The documents with each secret replaced by its kind's mark (overlapping spans by one mark) and n_chars renewed.

    Every column, row and null is kept; a document without secrets keeps its text unchanged.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in batches:
            columns = list(b.columns)
            texts = columns[at].to_pylist()
            for i, spans in enumerate(s.spans(columns[at])):
                if spans:
                    out, done = [], 0
                    for lo, k, hi in spans:
                        if lo >= done:
                            out += [texts[i][done:lo], mark.format(kind=rules[k].kind)]
                        done = max(done, hi)
                    texts[i] = "".join(out) + texts[i][done:]
            columns[at] = pa.array(texts, columns[at].type)
            if count >= 0:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(hide, docs.schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
