"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cue words.
From each anchor a local parser expands to the boundaries of what it belongs to and validates it:

=========  ==============================  ==================================================================
kind       anchor                          what is found
=========  ==============================  ==================================================================
email      ``@``                           local part to the left, domain of two labels or more to the right
ip         a digit                         four dotted numbers of at most 255
card       a digit                         16 to 19 digits, single spaces or dashes between, passing Luhn
phone      ``+``                           8 to 15 digits with spaces, brackets, dots and dashes
address    ``://``                         http, https or ftp address whose host has a dot, without closing marks
account    ``iban``, ``account``, ...      the number after the cue: an IBAN passing its check, or 6 to 17 digits
secret     ``token``, ``password``, ...    the value after the cue and ``=`` or ``:``, quoted or not: 16 characters of a key or more with
                                           a letter and two digits; after words for passwords 8 with a letter and a digit
=========  ==============================  ==================================================================

Each kind is searched from left to right without overlaps, with the boundaries of these patterns:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``,
card ``[0-9]([ -]?[0-9])+``, phone ``\\+[0-9][ ().0-9-]+[0-9]``; a match that fails its check is passed over whole.

Defined cases: a null text is empty; offsets are code points, end exclusive; a text is scanned once,
whatever its length, and no anchor is visited twice.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .columns import append_columns, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "secret")
SECRET_CUES = ("token", "secret", "key", "apikey", "credential", "credentials", "bearer")
PASSWORD_CUES = ("password", "passwd", "pwd", "passphrase")
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "ssn", "passport")

# The patterns of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SCHEME = re.compile(r"(?:https?|ftp)\Z", re.ASCII | re.IGNORECASE)
_REST = re.compile(r"[^\s\"'<>`|\\^{}]+")
_VALUE = re.compile(r"(?:[\s._-]?(?:number|nummer|no|nr|num|id)\b)?[\s.:=#]{0,3}([A-Za-z]{0,2}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)", re.ASCII | re.IGNORECASE)

_SECRET = re.compile(r"[\"']?[\x20\t]{0,3}(?::=|=>|[:=])[\x20\t]{0,3}[\"'`]?([A-Za-z0-9+/_.~-]+={0,2})")


def secret(cue: str, value: str) -> bool:
    """Whether the value after a cue looks like a key or password and not like a word."""
    digits = sum(c in "0123456789" for c in value)
    letters = sum(c.isalpha() for c in value)
    if cue.lower() in PASSWORD_CUES:
        return len(value) >= 8 and digits >= 1 and letters >= 1
    return len(value) >= 16 and digits >= 2 and letters >= 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = re.sub("[ -]", "", value).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for anchor, cues in (("cue", CUES), ("secret", SECRET_CUES + PASSWORD_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, (anchor, len(form)))
    found.make_automaton()
    return found


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each kind in order of its starts."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the search of a kind goes on
    for last, (anchor, width) in anchors().iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at >= done["card"]:
                match = _CARD.match(text, at)
                if match:
                    done["card"] = match.end()
                    digits = re.sub("[ -]", "", match.group()) if match.end() - at <= 40 else ""
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(match.span())
            if at >= done["ip"]:
                match = _DOTTED.match(text, at)
                if match:
                    done["ip"] = match.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.group().split(".")):
                        out["ip"].append(match.span())
                else:
                    done["ip"] = _DIGITS.match(text, at).end()
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            match = _DOMAIN.match(text, at + 1) if start < at else None
            if match:
                done["email"] = match.end()
                out["email"].append((start, match.end()))
        elif anchor == "plus":
            if at >= done["phone"]:
                match = _PHONE.match(text, at)
                if match:
                    done["phone"] = match.end()
                    if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
                        out["phone"].append(match.span())
        elif anchor == "scheme":
            scheme = _SCHEME.search(text, max(done["address"], at - 5), at)
            match = _REST.match(text, last + 1) if scheme else None
            if match:
                end = match.start() + len(match.group().rstrip(".,;:!?)]"))
                done["address"] = match.end()
                host = re.split("[/?#]", text[match.start() : end], maxsplit=1)[0]
                if "." in host.strip("."):
                    out["address"].append((scheme.start(), end))
        elif anchor == "secret":
            if at >= done["secret"] and not (at and text[at - 1].isalnum()):
                match = _SECRET.match(text, last + 1)
                if match and secret(text[at : last + 1], match.group(1)):
                    out["secret"].append(match.span(1))
                    done["secret"] = match.end()
        elif at >= done["account"] and not (at and text[at - 1].isalnum()):
            match = _VALUE.match(text, last + 1)
            if match:
                value = match.group(1)
                if iban(value) or 6 <= sum(c.isdigit() for c in value) <= 17:
                    out["account"].append(match.span(1))
                    done["account"] = match.end()
    return out


SPAN_FIELDS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def find(docs: DataFrame, text: str = "text", spans_as: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the array ``spans_as`` of (kind, start, end), by kind as listed, then start."""

    def make():
        def work(batch):
            kinds, starts, ends, offsets = [], [], [], [0]
            for value in texts_of(batch, "text"):
                for kind, found in spans(value).items():
                    for start, end in found:
                        kinds.append(kind)
                        starts.append(start)
                        ends.append(end)
                offsets.append(len(kinds))
            items = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"]
            )
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)]

        return work

    return append_columns(docs, text, T.StructType([T.StructField(spans_as, SPAN_FIELDS)]), make, keep)


def redacted(docs: DataFrame, text: str = "text", spans_as: str = "spans", out: str = "redacted") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets.

    Where spans of several kinds overlap, the one that starts first goes, the longer one at a tie.
    """
    ordered = F.array_sort(
        F.transform(F.col(spans_as), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    )
    none = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state, s):
        return F.when(s["start"] < state["at"], state).otherwise(
            F.struct(
                F.concat(
                    state["done"], F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">")
                ).alias("done"),
                (-s["back"]).alias("at"),
            )
        )

    def finish(state):
        return F.concat(state["done"], F.substring(F.col(text), state["at"] + 1, F.length(text)))

    return docs.withColumn(out, F.when(F.size(spans_as) == 0, F.col(text)).otherwise(F.aggregate(ordered, none, step, finish)))
