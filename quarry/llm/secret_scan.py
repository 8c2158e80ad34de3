"""Secret scan by assignment-aware lexing.

A text is lexed for assignments in source and configuration syntax - name = "literal", "name":
'literal', NAME=value, name: value, name := "...", name => "...", <name>literal</name>, --name=value -
into name-literal pairs. The right side may join literals and names with +, . or white space; names
that were assigned a constant before are replaced by it, so a secret is found where its value is
written and where a sensitive name takes it over. Unquoted values and tags are constants too, and $X and
${X} are expanded in them and in strings other than single-quoted ones. A literal is then scored by what its target's name
says (password, token, api key ...) and by what the literal looks like.

A joined value is kept as the parts it refers to and written out only to be scored, so constants that
double again and again take no memory. Lexing takes time in proportion to the text.

The value itself is not stored: only its place, length and SHA-256.

Defined cases
* null or empty text, text without an assignment: no rows. Empty table: no rows.
* null doc_id: reported with a null id. Repeated rows: each is reported.
* several equal findings in a text: one row for each place.
* very long texts: lexed whole; constants hold from their assignment to the end of the text.
* a value of more than MOST_JOINED characters that is joined from constants: judged by its longest part.
* a value of fewer than 6 characters or with more than 2 blanks: not taken for a secret. A name of more than 64 parts (a.b.c ...): its last 64.
* a value that passed more than MOST_NAMED constants: the nearest of them are named, after '...'.
* ties (a value under several names, parts of equal length): each is reported; the first part gives the place.
* extra columns, also with the names of the result: ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

LEAST_SCORE = 0.5
#: Characters of a joined value that are written out to be scored, and constants of its history that are named.
MOST_JOINED, MOST_NAMED = 1 << 12, 64
SCHEMA = "doc_id long, target string, start int, length int, sha256 string, score double, through string"

_NAME = r"(?<![\w$])[A-Za-z_$][\w$]*(?:[.\-][\w$]+){0,63}"
_TARGET = re.compile(rf"""(?P<q>["'])(?P<quoted>[\w.$ \-]+)(?P=q)\]?[ \t]*(?P<op1>=>|:=|=(?![=~])|:(?![:/]))|(?P<name>{_NAME})(?:\[["'](?P<key>[\w.\-]+)["']\])?[ \t]*(?P<op2>=>|:=|\?=|=(?![=~>])|:(?![:/]))|<(?P<tag>{_NAME})>(?=[^<>\s])""")
_STRING = re.compile(r'''[rbfuRBFU]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`]*)`)''', re.S)
_NAMED = re.compile(rf"\$\{{(?P<braced>{_NAME})\}}|\$?(?P<plain>{_NAME})(?![\w(\[/@:+=])")
_REF = re.compile(rf"\$(?:\{{(?P<braced>{_NAME})\}}|(?P<plain>[A-Za-z_]\w*))")
_BARE = re.compile(rf"(?:\$\{{{_NAME}\}}|[^\s\"'`,;<>(){{}}\[\]])+")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?(?=\s*[\"'`$A-Za-z_])|&|\|\|)?[ \t]*\\?\n?[ \t]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signing": 0.6, "jwt": 0.8, "salt": 0.5, "key": 0.5, "cookie": 0.5, "dsn": 0.5}
_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("auth", "key"): 1.0, ("account", "key"): 0.9, ("connection", "string"): 0.6}
_HARMLESS = {"count", "max", "min", "length", "len", "size", "type", "url", "uri", "path", "file", "name", "id", "field", "hint", "label", "prompt", "expiry", "expires", "ttl", "limit", "format", "policy", "public", "tokenizer", "tokens", "regex", "pattern", "header", "column", "primary", "foreign", "index"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|(?:your|my|the|some|insert|enter|put)[_\- ].*|.*(?:change.?me|placeholder|example|dummy|redacted).*|null|none|nil|true|false|undefined|empty|test|todo|password|secret|token)$")
_KNOWN = re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_\w{30,}$|^sk-[\w\-]{20,}$|^xox[abprs]-[\w\-]{10,}$|^eyJ[\w\-]+\.[\w\-]+\.[\w\-]*$|^AIza[\w\-]{30,}$|-----BEGIN [A-Z ]*PRIVATE KEY")
_MAY_BE_KNOWN = re.compile(r"A[KS]IA|AIza|gh|sk-|xox|eyJ|[a-z][a-z0-9+.\-]{0,30}:")
_IN_URL = re.compile(r"^[a-z][a-z0-9+.\-]{0,30}://[^\s/:@]+:(?P<pass>[^\s/@]+)@")


class Pair:
    """target takes the joined parts, which are text or pairs referred to by a name; start and end are the place of the longest part where it's written."""

    def __init__(self, target: str, parts: list[str | Pair], start: int, end: int, uses: tuple[tuple[str, Pair], ...] = (), quoted: bool = True, setting: bool = False) -> None:
        self.target, self.start, self.end, self.uses, self.quoted = target, start, end, uses, quoted
        self.setting = setting  # unquoted, in the syntax of a setting: NAME=value, or alone on its line
        parts = [p for p in parts if (p if isinstance(p, str) else p.length)]
        self.parts = parts[0].parts if len(parts) == 1 and not isinstance(parts[0], str) else parts  # so that writing out n characters takes n steps
        self.length = sum(len(p) if isinstance(p, str) else p.length for p in parts)
        longest = max(parts, key=lambda p: len(p) if isinstance(p, str) else p.length, default="")
        self.told: str | Pair = self if self.length <= MOST_JOINED else longest if isinstance(longest, str) else longest.told
        self.head, self.key = "", False
        for p in parts:
            self.key |= "-----BEGIN" in p if isinstance(p, str) else p.key
            if len(self.head) < 64:
                self.head += p[:64] if isinstance(p, str) else p.head

    @property
    def literal(self) -> str:
        """The value; if it's joined and longer than MOST_JOINED, its longest part."""
        out, stack = [], [self.told]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            else:
                stack += reversed(p.parts)
        return "".join(out)

    @property
    def through(self) -> tuple[str, ...]:
        """The names of the constants that the value passed, the nearest last."""
        out: dict[str, None] = {}
        seen, stack = set(), list(self.uses)
        while stack:
            name, p = stack.pop()
            if (name, id(p)) in seen:
                continue
            if len(out) == MOST_NAMED and name not in out:
                return ("...", *reversed(out))
            seen.add((name, id(p)))
            out.setdefault(name)
            stack += p.uses
        return tuple(reversed(out))


def _string(m: re.Match) -> tuple[str, int, int]:
    k = next(k for k in "abcde" if m[k] is not None)
    return m[k], m.start(k), m.end(k)


def _expanded(p: Pair, constants: dict[str, Pair]) -> Pair:
    """p, of one text, with the constants that it refers to as $X or ${X} put in; placed at its longest part."""
    text = p.parts[0] if p.parts else ""
    parts, uses, at, own = [], [], 0, 0
    for m in _REF.finditer(text):
        if (c := constants.get(m["braced"] or m["plain"])) is not None:
            parts += [text[at : m.start()], c]
            uses.append((m["braced"] or m["plain"], c))
            own += m.start() - at
            at = m.end()
    if not uses:
        return p
    parts.append(text[at:])
    own += len(text) - at
    longest = max((x for x in parts if not isinstance(x, str)), key=lambda c: c.length)
    start, end = (p.start, p.end) if own > longest.length else (longest.start, longest.end)
    return Pair(p.target, parts, start, end, tuple(uses), p.quoted, p.setting)


def _setting(text: str, m: re.Match, start: int, end: int) -> bool:
    if text[end : end + 1] not in ("", " ", "\t", "\r", "\n", ";", "<"):
        return False
    at = m.start()
    while at and text[at - 1] in " \t-":
        at -= 1
    alone = (not at or text[at - 1] == "\n") and not re.match(r"[ \t]*[^\s#;]", text[end : end + 80].split("\n")[0])
    return alone or (m["op2"] in ("=", "?=") and m.end() == start and text[m.end() - 2 : m.end() - 1] not in (" ", "\t"))


def lex(text: str) -> Iterator[Pair]:
    """The name-literal pairs of a text, in order; a joined right side gives one pair, placed at its longest part."""
    constants: dict[str, Pair] = {}
    at = 0
    while m := _TARGET.search(text, at):
        at = m.end()
        if m["tag"]:
            close = f"</{m['tag']}>"
            end = text.find("<", at)
            if end < 0 or not text.startswith(close, end):
                continue
            pair = _expanded(Pair(m["tag"], [text[at:end].strip()], at, end), constants)
            at = end + len(close)
            constants[pair.target] = pair
            yield pair
            continue
        target = m["quoted"] or m["key"] or m["name"]
        op = m["op1"] or m["op2"]
        while at < len(text) and text[at] in " \t":
            at += 1
        parts: list[Pair] = []
        while True:
            if s := _STRING.match(text, at):
                value, lo, hi = _string(s)
                part = Pair(target, [value], lo, hi)
                parts.append(part if s["b"] is not None or s["d"] is not None else _expanded(part, constants))
            elif (s := _NAMED.match(text, at)) and (name := s["braced"] or s["plain"]) in constants and (constants[name].quoted or s[0].startswith("$")):
                c = constants[name]
                parts.append(Pair(target, [c], c.start, c.end, ((name, c),)))
            elif not parts and (s := _BARE.match(text, at)) and (op in ("=", "?=", ":") and (not s[0].startswith(("$", "@", "%", "&")) or (v := _REF.match(s[0])) and (v["braced"] or v["plain"]) in constants)):
                parts.append(_expanded(Pair(target, [s[0]], at, s.end(), quoted=False, setting=_setting(text, m, at, s.end())), constants))
                at = s.end()
                break
            else:
                break
            at = s.end()
            j = _JOIN.match(text, at)
            if not j[0].strip(" \t\\\n") and "\n" in j[0] and "\\" not in j[0]:
                break
            if _STRING.match(text, j.end()) or ((n := _NAMED.match(text, j.end())) and (n["braced"] or n["plain"]) in constants and j[0].strip()):
                at = j.end()
                continue
            break
        if not parts:
            continue
        longest = max(parts, key=lambda p: p.length)
        pair = Pair(target, parts, longest.start, longest.end, tuple(u for p in parts for u in p.uses), parts[0].quoted, parts[0].setting)
        constants[target] = pair
        yield pair


def name_score(name: str) -> float:
    """How much a target's name says that its value is a secret: 0 to 1."""
    parts = [p.lower() for p in _PART.findall(name.rsplit(".", 1)[-1])]
    joined = "".join(parts)
    best = max([SENSITIVE.get(p, 0.0) for p in parts] + [_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:])] + [SENSITIVE.get(joined, 0.0)], default=0.0)
    return 0.2 * best if parts and parts[-1] in _HARMLESS or {"max", "min", "public", "num"} & set(parts) else best


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: 0 to 1."""
    if _KNOWN.search(value):
        return 1.0
    if len(value) < 6 or _PLACEHOLDER.match(value) or value.count(" ") > 2:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return max(0.0, min(1.0, 0.35 * min(1.0, n / 16) + 0.45 * min(1.0, entropy / 3.5) + 0.1 * kinds)) * (0.6 if " " in value else 1.0)


def scan(text: str | None) -> list[tuple[str, int, int, str, float, str]]:
    """(target, start, length, sha256, score, through) of each finding; start counts characters from 0."""
    if not text or not any(c in text for c in "=:<"):
        return []
    found = []
    for p in lex(text):
        name = name_score(p.target)
        if not name and not p.key and not _MAY_BE_KNOWN.match(p.head):
            continue
        value, start, end = p.literal, p.start, p.end
        if u := _IN_URL.match(value):
            value, start, end, name = u["pass"], p.start + u.start("pass"), p.start + u.end("pass"), max(name, 0.9)
        looks = literal_score(value)
        if not p.quoted and looks < 1.0:
            names = re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+", value) or name_score(value)  # another variable's name
            looks *= 0.8 if re.search("[0-9]", value) or p.setting and not names else 0.3
        score = 1.0 if looks == 1.0 and _KNOWN.search(value) else name * looks
        if score >= LEAST_SCORE:
            found.append((p.target, start, end - start, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest(), round(score, 4), ">".join(p.through)))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
    names = ["doc_id", "target", "start", "length", "sha256", "score", "through"]
    for b in batches:
        rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for f in scan(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per secret. Texts without a sign of assignment can't hold a pair, so they don't leave the JVM."""
    may = F.col("text").contains("=") | F.col("text").contains(":") | F.col("text").contains("</")
    return docs.select("doc_id", "text").where(may).mapInArrow(lean(_scan), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the secrets in all documents."""
    return find_secrets(read_table(spark, sf_dir, "documents"))
