"""Secret scan: fixed patterns, and password guess cost for values in a credential context.

A value that stands after a credential word and a colon or equals sign is cut into words, dates,
repeats, keyboard walks and brute-force spans so that the guesses to find it are fewest (dynamic
programming over places). If even that many guesses are out of reach, the value is a secret.

Defined results: a null or empty text has no spans; every text is scanned whole; the work for a
value is linear in its length; a path, an address or a name in code is judged by its parts; spans of one kind do not overlap, those of two kinds may; repeated rows
are answered one by one; an empty table gives no rows; other columns are not read.
"""

import functools
import json
import math
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import LOWER, text_rows, texts_of
from threatloom.llm.tokens import tokenizer_source

# The base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"(?a)AKIA[A-Z0-9]+")
HEX, HEX_BYTES = re.compile(r"(?a)[0-9a-f]{16,}"), re.compile(rb"[0-9a-f]{16,}")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "guess")

# Credential words beyond the base ones, and values in quotes or with other signs. Long words may stand at the end of
# any name; short ones begin at a word's start: after any sign or prefix, or at a capital (camel case).
_STARTS = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
_VALUE = r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?([^\s"'<>,;()\[\]{}]+))"""
CONTEXT = re.compile(
    rf"""(?ai)(?:pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|(?:access|private|secret|account)[_-]?key|credentials?|authorization|{_STARTS}(?:pass|pwd|auth[_-]?key|auth|bearer))"""
    rf"""["']?\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic|token)\x20+)?{_VALUE}|\b(?:bearer|basic)\x20+([a-z0-9+/_.=~-]+)"""
)
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"basic")

# Frequent words of passwords and placeholders, in order of frequency.
WORDS = (
    "password pass admin welcome login letmein qwerty master dragon monkey shadow sunshine princess football baseball "
    "secret changeme example test demo user root guest default public private access system server service database "
    "mysql oracle postgres redis docker github gitlab google amazon azure api key token auth value your here none null "
    "true false love hello summer winter spring autumn monday friday january march april june july august october "
    "company office home house family freedom whatever trust super secure security temp temporary string placeholder"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")

# Paths and addresses (a scheme, a root, a home, a drive, or folders named by words), dotted names of code, and what cuts them.
PLACE = re.compile(r"(?ai)[a-z][a-z0-9+.-]*://|(?:~|\.{1,2})?/(?=[a-z._-]+/)|[a-z]:[\\/]|[a-z_]{3,}(?:/[a-z_.-]{2,})+/?\Z")
NAME = re.compile(r"(?a)[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")
PARTS = re.compile(r"[/\\?&=#:@.]+")

# Bits of guesses from which a value counts as a secret, and the shortest value looked at.
SECRET_BITS, SECRET_CHARS = 40.0, 8

_RANK = {w: i + 2 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))

# The vocabulary file whose pieces that begin words are the words of prose, in order of frequency.
VOCABULARY = "byte_bpe_50k.json"


@functools.lru_cache(maxsize=1)
def prose_words() -> dict:
    """{word: rank}: the words above, then those of the vocabulary file. Read where the job is planned, and sent to the tasks."""
    ranks = dict(_RANK)
    for piece in json.loads(tokenizer_source(public_tokenizers.path(VOCABULARY)))["model"]["vocab"]:
        word = piece[1:].lower()
        if piece[0] == "\u0120" and 3 <= len(word) <= _LONGEST_PROSE and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(ranks) + 2)
    return ranks


_LONGEST_PROSE = 20
_NEXT = {
    (a, b)
    for r, row in enumerate(ROWS)
    for i, a in enumerate(row)
    for s in (r - 1, r, r + 1)
    if 0 <= s < len(ROWS)
    for j, b in enumerate(ROWS[s])
    if abs(i - j) <= 1 and a != b
}


def char_bits(value: str) -> list:
    """Bits of brute force for each character: the size of its class, letters of both cases if both occur."""
    letters = 52 if any(c.islower() for c in value) and any(c.isupper() for c in value) else 26
    size = lambda c: 10 if c.isdigit() else letters if c.isalpha() and c.isascii() else 33 if c.isascii() else 100
    return [math.log2(size(c)) for c in value]


def guess_segments(value: str, ranks=None) -> list:
    """(start, end, bits) of the words (``ranks`` or the fixed ones), dates, repeats and walks in ``value``.

    Runs are listed as longest ones only, so their number grows with the value's length.
    """
    low, each = value.lower(), char_bits(value)
    ranks, longest = (_RANK, _LONGEST) if ranks is None else (ranks, _LONGEST_PROSE)
    plain, found = low.translate(LEET), []
    n = len(low) if len(low) == len(value) else 0
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(plain[i:j])
            if rank:
                own, shaped = value[i:j], 0.0
                if own != low[i:j]:
                    shaped += 1.0 if own[0].isupper() and own[1:] == low[i + 1 : j] or own.isupper() else float(j - i)
                if low[i:j] != plain[i:j]:
                    shaped += 1.5
                found.append((i, j, math.log2(rank) + shaped))
    found += [(m.start(), m.end(), math.log2(365 * 120) + (m.end() - m.start() > 8) * 2) for m in DATE.finditer(value)]
    for same, least, cost in (
        (lambda i: value[i] == value[i - 1], 3, lambda i, size: each[i] + math.log2(size)),
        (lambda i: (low[i - 1], low[i]) in _NEXT, 4, lambda i, size: math.log2(47) + size * 1.3),
        (lambda i: abs(ord(low[i]) - ord(low[i - 1])) == 1, 3, lambda i, size: math.log2(26) + math.log2(size) + 1),
    ):
        begin = 0
        for i in range(1, n + 1):
            if i == n or not same(i):
                if i - begin >= least:
                    found.append((begin, i, cost(begin, i - begin)))
                begin = i
    for m in re.finditer(r"(.{2,32}?)\1+", value):
        found.append((m.start(), m.end(), sum(each[m.start() : m.end(1)]) + math.log2((m.end() - m.start()) / len(m[1]))))
    return found


def guess_bits(value: str, ranks=None) -> float:
    """Fewest guesses, in bits, over all ways to cut ``value`` into segments.

    A brute-force span costs the characters it may have at each place; each change of segment costs a bit.
    """
    ends = {}
    for i, j, bits in guess_segments(value, ranks):
        ends.setdefault(j, []).append((i, bits))
    best = [0.0]
    for j, own in enumerate(char_bits(value), 1):
        cost = best[j - 1] + own
        for i, bits in ends.get(j, ()):
            cost = min(cost, best[i] + bits + 1.0)
        best.append(cost)
    return best[-1]


def value_bits(value: str, after: str, ranks=None) -> float:
    """``guess_bits`` of a context value; of a path, an address or a name in code, that of its costliest part.

    Such a value is made of separators and parts that are no secret together, however long it is: it
    is one only if a part is (a key in an address, a password before its ``@``). ``after`` is the character behind it.
    """
    if PLACE.match(value) or after in ("[", "(") and NAME.fullmatch(value):
        return max((guess_bits(part, ranks) for part in PARTS.split(value) if part), default=0.0)
    return guess_bits(value, ranks)


def secret_spans(text: bytes, ranks=None) -> list:
    """(kind, start, end, value start, bits) in one text: code points, end exclusive, in order of start and kind.

    Every value in a credential context is costed; ``ranks`` are the words of prose (``prose_words``). A value
    that reaches beyond a base span it overlaps is the rest of that secret, whatever its cost.
    """
    low = text.translate(LOWER)
    out, whole = [], None
    values = []
    if any(w in low for w in ASSIGN_WORDS):
        whole = text.decode(errors="replace")
        for m in ASSIGN.finditer(whole):
            if m.end(2) - m.start(2) >= 12:
                out.append(("assign", m.start(), m.end(), m.start(2), None))
                values.append((m.start(2), m.end(2)))
    if b"AKIA" in text:
        whole = whole or text.decode(errors="replace")
        out += [("access", m.start(), m.end(), m.start(), None) for m in ACCESS.finditer(whole) if m.end() - m.start() >= 18]
    if HEX_BYTES.search(text):
        whole = whole or text.decode(errors="replace")
        out += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(whole)]
    if any(w in low for w in CONTEXT_WORDS):
        whole, at = whole or text.decode(errors="replace"), 0
        for m in CONTEXT.finditer(whole):
            i = m.lastindex
            a, value = m.start(i), m[i].rstrip(".,;:!?")
            b = a + len(value)
            while at < len(values) and values[at][1] <= a:
                at += 1
            base = at < len(values) and values[at][0] < b
            if base and values[at][0] <= a and b <= values[at][1] or not base and len(value) < SECRET_CHARS:
                continue
            ranks = ranks or prose_words()
            bits = value_bits(value, whole[b : b + 1], ranks)
            if base or bits >= SECRET_BITS:
                out.append(("guess", a, b, a, bits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value_start", T.LongType()), T.StructField("bits", T.DoubleType())]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("bits", pa.float64())]))


def find_secrets(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, spans) of each document."""

    words = docs.sparkSession.sparkContext.broadcast(prose_words())

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "value_start", "bits"), s)) for s in secret_spans(t, words.value)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW)], names=["id", "spans"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)])
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def secret_digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) from the spans of each document."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base: Column = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col="text", mark="[secret]", chars_col=None) -> DataFrame:
    """``docs`` with every secret value replaced by ``mark``; rows and columns stay.

    ``chars_col`` names a column that holds the text's number of characters; it follows the text.
    """
    names, words = docs.columns, docs.sparkSession.sparkContext.broadcast(prose_words())

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for text in batch.column(at).to_pylist():
                spans = secret_spans(text.encode(), words.value) if text else ()
                if spans:
                    kept, upto = [], 0
                    for a, b in _joined((s[3], s[2]) for s in spans):
                        kept += [text[upto:a], mark]
                        upto = b
                    text = "".join(kept) + text[upto:]
                out.append(text)
            columns = [batch.column(i) if i != at else pa.array(out, batch.schema.field(at).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else out


def _joined(spans):
    """Overlapping spans as one, in order."""
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
