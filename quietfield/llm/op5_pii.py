"""Personal data by anchor expansion: an Aho-Corasick pass finds cues, local parsers expand and check them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "credentials", "account", "address", "secret"]
BASE = KINDS[:4]
RANK = {kind: n for n, kind in enumerate(KINDS)}
ACCOUNT_CUES = [
    "iban", "account", "acct", "konto", "kontonummer", "kontonr", "cuenta", "compte", "passport", "passeport", "pasaporte", "reisepass", "ssn",
]
ADDRESS_CUES = ["street", "avenue", "road", "boulevard", "straße", "strasse", "rue", "calle", "avenida", "platz", "weg", "allee"]
SUFFIX_CUES = {"straße", "strasse", "platz", "weg", "allee"}  # also written as the end of a street's name
SECRET_CUES = ["password", "passwd", "pwd", "passwort", "contraseña", "mot de passe", "token", "secret", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "private_key"]
KEY_CUES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "-----BEGIN ", "Bearer ", "bearer "]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: lengths of an IBAN by country, where they are fixed
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: possessive: the parts cannot overlap, so giving characters back never helps
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/@:?#]{1,64}:[^\s/@?#]{1,128}@(?=[A-Za-z0-9\[])")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}\Z")
AFTER_CUE = re.compile(r"(?:\s{0,3}(?:no|nr|n°|number|num|nummer|número|numéro|code)\b\.?)?[\s:#=.-]{1,4}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}")
NUMBER = re.compile(r"(?:[A-Z]{1,2}[0-9]{6,9}|[0-9](?:[\x20-]?[0-9]){7,16})(?![A-Za-z0-9])")
NUMBER_BEFORE = re.compile(r"(?<![\w.])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][\w'’-]{1,20}\x20){1,3}\Z")
NAME_AFTER = re.compile(r"(?:\x20(?:de|du|des|la|le|del|los|las|l'))*(?:\x20[A-Z][\w'’-]{1,20}){1,3},?\x20[0-9]{1,5}(?![\w])")
NUMBER_AFTER = re.compile(r",?\x20[0-9]{1,4}[A-Za-z]?(?![\w])")
GIVEN = re.compile(r"[\w-]{0,20}[\"']?\s{0,3}(?:=>|[:=])\s{0,3}[\"']?([^\s\"',;]{6,200})")
CLOUD_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
HUB_KEY = re.compile(r"gh[pousr]_[A-Za-z0-9]{30,255}(?![A-Za-z0-9])")
PEM_KEY = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]{0,20000}-----END [A-Z ]{0,30}PRIVATE KEY-----)?")
BEARER = re.compile(r"[Bb]earer ([A-Za-z0-9._~+/-]{16,2000}=*)")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """End of the valid IBAN that begins at a place, -1 without one: the length of its country decides, not where capitals end."""
    m = IBAN.match(text, at)
    if not m:
        return -1
    size = IBAN_LENGTH.get(text[at : at + 2])
    code, ends = "", []
    for i in range(at, m.end()):
        if text[i] != " ":
            code += text[i]
            ends.append(i + 1)
    for n in [size] if size else range(len(code), 14, -1):
        if n <= len(code) and iban_ok(code[:n]) and not text[ends[n - 1] : ends[n - 1] + 1].isalnum():
            return ends[n - 1]
    return -1


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", ("@", 1))
    out.add_word("+", ("+", 1))
    out.add_word("://", ("url", 3))
    for a in "0123456789":  # a digit before a dot, and digits at most one blank or dash apart
        out.add_word(a + ".", ("ip", 2))
        for between in ("", " ", "-"):
            for b in "0123456789":
                out.add_word(a + between + b, ("card", 2 + len(between)))
    for kind, cues in (("account", ACCOUNT_CUES), ("address", ADDRESS_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                out.add_word(form, (kind, len(form)))
    for cue in KEY_CUES:
        out.add_word(cue, ("key", len(cue)))
    out.make_automaton()
    return out


def _address(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The house number and street about a cue at [at, end)."""
    inside = at > 0 and text[at - 1].isalnum()
    if inside and text[at:end].lower() not in SUFFIX_CUES or end < len(text) and text[end].isalnum():
        return None
    start = at
    while start > 0 and at - start < 40 and (text[start - 1].isalnum() or text[start - 1] == "-"):
        start -= 1
    if (inside or start == at and text[at].isupper()) and text[at:end].lower() in SUFFIX_CUES and text[start].isupper() and (m := NUMBER_AFTER.match(text, end)):
        return start, m.end()
    if inside:
        return None
    if m := NUMBER_BEFORE.search(text[max(0, at - 90) : at]):
        return max(0, at - 90) + m.start(), end
    m = NAME_AFTER.match(text, end)
    return (at, m.end()) if m else None


def _secret(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The value given to a name that ends in a cue: of six characters or more, digits among them or sixteen."""
    m = GIVEN.match(text, end)
    if m and (len(m[1]) >= 16 or any("0" <= c <= "9" for c in m[1])):
        return m.start(1), m.end(1)
    return None


def _key(text: str, at: int) -> tuple[int, int] | None:
    """A key of a known form at a place."""
    if at and text[at - 1].isalnum():
        return None
    m = CLOUD_KEY.match(text, at) or HUB_KEY.match(text, at) or PEM_KEY.match(text, at)
    if m:
        return m.start(), m.end()
    m = BEARER.match(text, at)
    return (m.start(1), m.end(1)) if m else None


def find_spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of every finding, in that order."""
    out: list[tuple[int, int, int]] = []
    ends = [0] * len(KINDS)  # findings of a kind do not overlap
    for last, (kind, size) in cues.iter(text):
        at = last - size + 1
        if kind == "card":
            if at >= ends[2]:
                m = CARD.match(text, at)
                ends[2] = m.end()
                if m.end() - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
        elif kind == "ip":
            if at >= ends[1]:
                start = at
                while start > ends[1] and "0" <= text[start - 1] <= "9":
                    start -= 1
                if m := IP.match(text, start):
                    ends[1] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append((start, 1, m.end()))
        elif kind == "@":
            start = at
            while start > ends[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                ends[0] = m.end()
                out.append((start, 0, m.end()))
        elif kind == "+":
            if at >= ends[3] and (m := PHONE.match(text, at)):
                ends[3] = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif kind == "url":
            if (m := USERINFO.match(text, last + 1)) and SCHEME.search(text[max(0, at - 16) : at]):
                out.append((m.start(), RANK["credentials"], m.end() - 1))
        else:
            span = None
            if kind == "account":
                if not (at and text[at - 1].isalnum()) and (m := AFTER_CUE.match(text, last + 1)):
                    end = iban_end(text, m.end())
                    if end < 0 and (n := NUMBER.match(text, m.end())):
                        end = n.end()
                    span = (m.end(), end) if end > 0 else None
            elif kind == "address":
                span = _address(text, at, last + 1)
            else:
                span = _secret(text, at, last + 1) if kind == "secret" else _key(text, at)
                kind = "secret"
            rank = RANK[kind]
            if span and span[0] >= ends[rank]:
                ends[rank] = span[1]
                out.append((span[0], rank, span[1]))
    out.sort()
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = automaton()
    for batch in batches:
        counts, digests, joined = np.zeros((4, batch.num_rows), np.int64), [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            spans = find_spans(text, cues) if text else []
            named = [f"{KINDS[r]}:{s}:{e}" for s, r, e in spans]
            for _, r, _ in spans:
                if r < 4:
                    counts[r, row] += 1
            base = ",".join(x for x, (_, r, _) in zip(named, spans, strict=True) if r < 4)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            joined.append(",".join(named))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=["doc_id", *(f"n_{x}" for x in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of email, ip, card and phone, a digest of those spans, and all spans.

    Cues are at-signs, plus signs, `://` and words for accounts and streets, found in
    one pass, as are digits before a dot (ip) and digits side by side (card); each has a
    parser that expands to the boundaries and validates (Luhn, IBAN length and check
    digits, digit counts, octets).  Beside the four base kinds: credentials (user:password
    in a url), account (a number or IBAN after a cue), address (house number and street)
    and secret (a value given to a password or token, keys of known forms).
    Spans are kind:start:end in code points, end exclusive.  Null and empty texts have
    none; null and repeated ids stay, a row for a row; a very long text is searched whole;
    other columns are not looked at.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
