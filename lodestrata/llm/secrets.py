"""Secret scans by one automaton of all rules.

The rules are compiled on the driver to transition arrays, which travel with
the tasks.  Every byte of every text is read once by the automaton that tells
which texts hold a match at all; only in those are the spans looked for, in time
that grows with the text alone.  A private key ends where its base64 lines (24
characters at least, before its END any) do, so that no prose goes with it.
Spans are the leftmost, then longest matches, apart from each other, counted in
characters from 0.

Defined cases
* null or empty text: no finding; the stage keeps the row as it is.
* very long texts: read whole.  Repeated rows: each has its findings.
* a span that two rules match alike counts for the first.
* null doc_id: found, with a null doc_id.
* an empty table gives an empty result; columns besides doc_id and text are not
  read by ``scan``; ``redact`` returns all, with the text, and n_chars where there is one, made anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import columns
from ._text import blocks
from .automaton import Dfa, compiled, hits, spans

_ASSIGN = r"[ \t]{0,4}(?:=|:|=>|:=)[ \t]{0,4}[\"']?"
#: What an identifier has before a keyword, as in DB_PASSWORD or dbPassword; after ``.`` or ``-`` a match begins anew.
_NAME = r"[A-Za-z0-9_]*"
_HEADERS = r"(?:\s*(?:Proc-Type|Content-Domain|DEK-Info|Key-Info|MIC-Info|Originator-ID|Comment):[^\r\n]*)*"
#: Line ends, also as they are written inside strings.
_GAP = r"(?:\s|\\[nr])"
RULES = {
    "aws_access_key": r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "github_pat": r"github_pat_[A-Za-z0-9_]{36,}",
    "slack_token": r"xox[abeoprs]-[A-Za-z0-9\-]{10,}",
    "stripe_key": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_api_key": r"AIza[A-Za-z0-9_\-]{35}",
    "model_api_key": r"sk-[A-Za-z0-9_\-]{20,}",
    "gitlab_token": r"glpat-[A-Za-z0-9_\-]{20,}",
    "npm_token": r"npm_[A-Za-z0-9]{36}",
    "json_web_token": r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----" + _HEADERS + rf"(?:(?:{_GAP}+[A-Za-z0-9+/]{{24,}}={{0,2}})*|(?:{_GAP}+[A-Za-z0-9+/]+={{0,2}})*{_GAP}*-----END [A-Z ]{{0,24}}PRIVATE KEY-----)",
    "url_password": r"[a-z][a-z0-9+.\-]{1,12}://[A-Za-z0-9._\-]{1,40}:[^\s/@:\"']{3,}@[A-Za-z0-9.\-]+",
    "bearer": r"[Bb]earer[ \t]{1,4}[A-Za-z0-9._~+/\-]{20,}=*",
    "assigned": _NAME + r"(?:[Aa][Pp][Ii][_\-]?[Kk][Ee][Yy]|[Ss][Ee][Cc][Rr][Ee][Tt](?:[_\-]?[Kk][Ee][Yy])?|[Aa][Cc][Cc][Ee][Ss][Ss][_\-]?[Kk][Ee][Yy]|[Aa][Uu][Tt][Hh][_\-]?[Tt][Oo][Kk][Ee][Nn]|[Aa][Cc][Cc][Ee][Ss][Ss][_\-]?[Tt][Oo][Kk][Ee][Nn]|[Tt][Oo][Kk][Ee][Nn])[\"']?" + _ASSIGN + r"[A-Za-z0-9+/_\-]{16,}=*[\"']?",
    "password": _NAME + r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd])[\"']?" + _ASSIGN + r"[^\s\"',;]{6,}[\"']?",
}
_made: dict[tuple, tuple[Dfa, Dfa]] = {}


def automata(rules: dict[str, str]) -> tuple[Dfa, Dfa]:
    key = tuple(rules.items())
    if key not in _made:
        _made[key] = compiled(list(rules.values()))
    return _made[key]


FOUND = T.ArrayType(T.StructType().add("rule", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("sha256", T.StringType()))


def found_in(arr: pa.Array, find: Dfa, match: Dfa) -> list[list[tuple[int, int, int]] | None]:
    """Byte spans (start, end, rule) of each text, None where there are none."""
    out: list[list[tuple[int, int, int]] | None] = [None] * len(arr)
    for i, _, d, o in blocks(arr, 1 << 22):
        for k in np.flatnonzero(hits(find, d, o)):
            out[i + k] = spans(match, d[o[k] : o[k + 1]])
    return out


def finder(rules: dict[str, str]):
    names = list(rules)
    find, match = automata(rules)

    @arrow_udf(FOUND)
    def secrets(text: pa.Array) -> pa.Array:
        got = []
        for k, found in enumerate(found_in(text, find, match)):
            row = []
            if found:
                raw, at, chars = text[k].as_py().encode(), 0, 0
                for s, e, r in found:
                    chars += len(raw[at:s].decode())
                    size = len(raw[s:e].decode())
                    row.append({"rule": names[r], "start": chars, "end": chars + size, "sha256": hashlib.sha256(raw[s:e]).hexdigest()})
                    at, chars = e, chars + size
            got.append(row)
        return pa.array(got, pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sha256", pa.string())])))

    return secrets


def masker(rules: dict[str, str]):
    names = list(rules)
    find, match = automata(rules)

    @arrow_udf("string")
    def masked(text: pa.Array) -> pa.Array:
        """The text without its secrets; null where nothing is to be done."""
        got = []
        for k, found in enumerate(found_in(text, find, match)):
            if not found:
                got.append(None)
                continue
            raw, at, parts = text[k].as_py().encode(), 0, []
            for s, e, r in found:
                parts += [raw[at:s], b"<" + names[r].upper().encode() + b">"]
                at = e
            got.append(b"".join([*parts, raw[at:]]).decode())
        return pa.array(got, pa.string())

    return masked


def scan(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, rule, start, end and sha256 of each secret found."""
    found = docs.select("doc_id", F.explode(finder(rules)("text")).alias("s"))
    return found.select("doc_id", "s.rule", "s.start", "s.end", "s.sha256")


def redact(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The rows of docs with ``<RULE>`` in the place of each secret."""
    made = docs.withColumn("text", F.coalesce(masker(rules)("text"), "text"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return made.select(*columns(docs))
