"""Problem 4: credentials in source code and configuration, found through layers of encoding and redacted in place."""

from __future__ import annotations

import base64
import binascii
import re
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "REDACTED"
#: Formats of issued tokens.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{18,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}"
    r"|xox[abeoprs]-[0-9A-Za-z-]{14,}|xapp-[0-9A-Za-z-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[0-9A-Za-z_-]{35}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{36}|pypi-[\w-]{40,}|SG\.[\w-]{20,}\.[\w-]{20,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|SK[0-9a-f]{32}|AGE-SECRET-KEY-1[0-9A-Z]{50,})"
)
#: A name that says its value grants access, and words that say it doesn't.
SECRET_NAME = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|psk|secret|token|cred(?:ential)?s?|(?:api|access|auth|signing|private|secret|encryption|master|client|account|service|storage|shared|deploy|session|app)[_.-]?key|auth)(?:[_.-]?(?:value|key|v)?[_.-]?\d*)$")
NOT_NAME = re.compile(r"(?i)hash|digest|checksum|fingerprint|etag|sha\d|md5|public|pub_?key|header|ttl|length|min_|max_|count|_url|_uri|endpoint|_path|_file|_dir|_name$|_id$|_type|kind|label|hint|regex|pattern|expir|timeout|seconds|field|param|prefix|suffix|format|policy|placeholder|example|author(?!iz)|passenger|passive|bypass|compass|passed|tokenizer|tokens$")
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{2,}|\.{3,}|-+|_+|null|none|nil|undefined|true|false|todo|tbd|n/?a|empty|unset|changeme|change[_-]?(me|it|this)\S*|replace[_-]?\S*|redacted\S*|removed|dummy\S*|example\S*|sample\S*|placeholder\S*|fake\S*|mock\S*|test|testing|secret|password|passw0rd|token|your\S*|my[_-]?\S*|some\S*|insert\S*|enter\S*|put\S*|(?:the|an?)[_-]\S*|set[_-]?\S*)$"
    r"|[<\[{].*[>\]}]|your[_-]|[_-]here\b|EXAMPLE|^\$|^%\w+%$|^@|\$\{|\{\{|%\(|#\{|^(?:vault|env|ssm|arn|aws|gcp|azure|kms|sops|secretref|secret|file|ref|op|keyring|keychain|doppler|awssm|k8s|configmap)(?:[:/]|\+)|^enc\[|process\.env|os\.environ|getenv|^!(?:vault|secret|ref|env|sub|import|getatt)\b"
)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9 ]* )?PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9 ]* )?PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: What may stand between the lines of a key block: its headers, line ends however written, marks of strings and comments.
BETWEEN = re.compile(r"(?:\s|\\[nrt]|[\"'`+,\\#*/|.()-]|(?<=\n)[ \t#*/\"']*(?:Proc-Type|DEK-Info|Comment|Version|Hash|Charset|MessageID):[^\n]*|[A-Za-z0-9+/=]{1,15}(?=[ \t\r]*(?:\n|\\[nrt]|[\"'`])))*")
QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n$]|\\.)*`"
CHAIN = re.compile(rf"(?:{QUOTED})(?:[ \t]*(?:[+.&]|\.\.|\\)?[ \t]*\\?\n?[ \t]*(?:{QUOTED}))*")
LITERAL = re.compile(QUOTED)
ASSIGN = re.compile(r"(?<![\w$])([\"']?)([A-Za-z_$][\w$.-]*)\1(?:\[\])?[ \t]*(?::[ \t]*[A-Za-z_][\w<>\[\]|. ]*=(?![=>])|:=|=>|=(?![=>])|:(?![:=])|[ \t](?=[\"']))[ \t]*(?:[rbuf]{0,2}(?=[\"'`]))?")
DEFINE = re.compile(r"#[ \t]*define[ \t]+(\w+)[ \t]+(?=[\"'])")
BARE = re.compile(r"[^\s'\"`#;,(){}\[\]<>][^\s'\"`;,(){}\[\]<>]*")
CONFIG_LINE = re.compile(r"^[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+|declare[ \t]+-x[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*(?:=|:[ \t])[ \t]*(?=[^\s'\"=])")
#: The bare value of a setting or of a list's item.
SCALAR = re.compile(r"^[ \t]*(?:-[ \t]+)?(?:(?:export[ \t]+|set[ \t]+|ENV[ \t]+)?[A-Za-z_][\w./-]*[ \t]*(?:=|:[ \t])[ \t]*|-[ \t]+)([^\s'\"#]{12,})[ \t\r]*(?:#.*)?$")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"`<>]*:([^\s@/'\"`<>]+)@[\w\[]")
HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization\b[\"']?[ \t]*[:=,][ \t]*[\"'`]?(?:basic|bearer|token|apikey|digest)[ \t]+([A-Za-z0-9+/=_.~-]{6,})|(?i:\bbearer[ \t]+)([A-Za-z0-9+/=_.~-]{16,})")
KEYHEADER = re.compile(r"(?i)\bx-[\w-]*(?:key|token|secret|auth)[\w-]*[\"']?[ \t]*[:,][ \t]*[\"'`]?([A-Za-z0-9+/=_.~-]{12,})")
COMMAND = re.compile(r"(?<![\w-])(?:-u|--user|--proxy-user)[ =][\"']?[\w.@-]+:([^\s'\"`]+)|(?:--(?:password|passwd|pass|token|api-key|secret|auth-token|access-token)|sshpass -p)[ =][\"']?([^\s'\"`]+)|\b(?:mysql|mysqldump)\b[^\n]*?[ \t]-p([^\s'\"`]+)|\bdocker login\b[^\n]*?[ \t]-p[ \t]*([^\s'\"`]+)")
CONNECTION = re.compile(r"(?i)(?:^|[;?&\"'`,{ ])(?:password|pwd|passwd|accountkey|sharedaccesskey|sharedsecret|access_token|client_secret|api_key|apikey|token|sig)=([^;&\s'\"`}]+)")
CALL = re.compile(rf"(?i)\.?\b\w*(?:login|log_in|sign_?in|auth|authenticate|connect|set_?credentials|credentials?|basic_?auth)\w*\([ \t]*(?:{QUOTED})[ \t]*,[ \t]*({QUOTED})")
FALLBACK = re.compile(rf"(?i)(?:\benv(?:iron)?\b(?:\.get\b)?|\bgetenv\b|\bvar\b)[\[(.\"']*([A-Za-z_]\w*)[\"']?[\])]*[ \t]*(?:\|\||\?\?|,|\bor\b|\?:)[ \t]*({QUOTED})")
SPOKEN = re.compile(r"(?i)(?:^|[ \t])(?://|#|\*|--|;)[^\n]*?\b(?:(?:old|prod|test|temp|staging|root|admin|real|current)[ \t]+)?(?:key|login|pass(?:word)?|pwd|token|secret|creds?|works with|rotate me|temp)(?:[ \t]+is)?[ \t]*[:=][ \t]*([^\s'\"`]{8,})[ \t]*$")
#: A line is looked at if it holds one of these, in any case, or LONG matches: all that any rule can begin with.
KEYWORDS = ("pass", "pwd", "psk", "secret", "token", "key", "auth", "cred", "login", "log_in", "signin", "sign_in", "connect", "works with", "rotate me", "temp", "sig=", "-u ", "-u=", "--user", "--proxy-user", "mysql", "-----begin", "bearer", "environ", "getenv", ".env", "akia", "asia", "abia", "acca", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "sk-", "xox", "xapp-", "eyj", "aiza", "ya29.", "npm_", "pypi-", "sg.", "hf_", "dop_v1", "shpat_", "shpca_", "shppa_", "shpss_")
LONG = re.compile(
    r"[=:-][ \t]*[A-Za-z0-9+/=_-]{12,}[ \t\r]*(?:$|\n|#)|[\"'`][A-Za-z0-9+/=_-]{12,}[\"'`]|%[0-9A-Fa-f]{2}|\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3})|://[^\s/:]*:[^\s/]*@|SK[0-9a-f]{32}"
    r"|[\"'`][ \t]*(?:[+.&]|\.\.|\\)?[ \t]*\\?\n?[ \t]*(?=[\"'`])"
)
#: What matches i, k and s where case is ignored, besides their capitals.
FOLD = str.maketrans("İıKſ", "iiks")
PACKED = re.compile(r"^(?:[A-Za-z0-9+/_-]{12,}={0,2}|(?:%[0-9A-Fa-f]{2}|[\w.~+/=-]){12,}|(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-7]{3}|[\x20-\x5b\x5d-\x7e]){12,})$")


class Secret(NamedTuple):
    """One credential: the line (from 1) it begins on, its kind and the spans of ``code`` that hold it."""

    line_no: int
    kind: str
    spans: tuple[tuple[int, int], ...]


def _classes(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def plausible(value: str, least: int = 6) -> bool:
    """Whether a value under a secret's name may grant access: no placeholder, reference, label, number or word."""
    v = value.strip()
    if len(v) < least or PLACEHOLDER.search(v) or len(set(v)) < 4 or any(c.isspace() for c in v):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:[_-][A-Z0-9]+)*", v) and not (re.search(r"\d", v) and "_" not in v and len(v) >= 12):
        return False  # a label: LITERAL, END_OF_FILE
    if re.fullmatch(r"[\d.,:+-]+", v) or re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", v):
        return False
    if re.fullmatch(r"(?:sha\d+|md5)[:-]\S+|data:\S+|https?://[^@]*", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_./][a-z]+)*", v):
        return False  # words
    if re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+){0,3}", v) and all(len(w) > 2 and re.search("[aeiouy]", w.lower()) and not re.search("[^aeiouy]{4}", w.lower()) for w in re.findall(r"[A-Z]?[a-z]+", v)):
        return False  # words in one
    if re.fullmatch(r"X-(?:[A-Z][A-Za-z]*-?)+", v):
        return False
    return _classes(v) >= 2


def secret_name(name: str) -> bool:
    n = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.rsplit(".", 1)[-1].strip("\"'$"))
    n = re.sub(r"_[vV]?\d+$", "", n)
    return bool(SECRET_NAME.search(n)) and not NOT_NAME.search(n)


# --- key containers --------------------------------------------------------------------------------------------


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements (tag, from, to) of a DER sequence's content, or None if the grammar doesn't hold."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def key_container(data: bytes) -> bool:
    """Whether ``data`` is a private key by its binary grammar: PKCS#1, PKCS#8 (plain or encrypted), SEC 1, PKCS#12, OpenSSH, Java key store."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, kdf and kdf options are strings with a length of four bytes
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64
    if data[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):
        return len(data) > 12 and int.from_bytes(data[4:8], "big") in (1, 2)
    if not data or data[0] != 0x30:
        return False
    whole = _der(data, 0, len(data))
    if not whole or len(whole) != 1:
        return False
    inner = _der(data, whole[0][1], whole[0][2])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    first = int.from_bytes(data[inner[0][1] : inner[0][2]], "big") if tags[0] == 2 and inner[0][2] - inner[0][1] <= 2 else None
    if tags[0] == 2 and first in (0, 1) and len(tags) >= 9 and all(t == 2 for t in tags[:9]):
        return True  # PKCS#1
    if tags[:3] == [2, 0x30, 4] and first in (0, 1):
        return (_der(data, inner[1][1], inner[1][2]) or [(0, 0, 0)])[0][0] == 6  # PKCS#8
    if tags[:2] == [2, 4] and first == 1:
        return inner[1][2] - inner[1][1] >= 16  # SEC 1
    if tags == [0x30, 4]:
        return (_der(data, inner[0][1], inner[0][2]) or [(0, 0, 0)])[0][0] == 6  # encrypted PKCS#8
    return tags[:2] == [2, 0x30] and first == 3  # PKCS#12


# --- layers -------------------------------------------------------------------------------------------------------


def unpack(value: str) -> list[bytes]:
    """What one layer of base64, hex, percent or escape encoding of ``value`` may hold; only changes count."""
    out = []
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){16,}", value):
        out.append(bytes.fromhex(value))
    if len(value) >= 12 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", value):
        try:
            out.append(base64.b64decode(value.rstrip("=").replace("-", "+").replace("_", "/") + "=" * (-len(value.rstrip("=")) % 4), validate=True))
        except (binascii.Error, ValueError):
            pass
    if re.search(r"%[0-9A-Fa-f]{2}", value):
        out.append(unquote(value, errors="replace").encode())
    if re.search(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3})", value):
        out.append(re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([0-7]{3}))", lambda m: chr(int(m[1] or m[2] or "0", 16) if not m[3] else int(m[3], 8)), value).encode("utf-8", "replace"))
    return out


def hidden(value: str) -> str | None:
    """The kind of a credential inside an encoded literal, looked for layer by layer; None if there is none.

    Each layer is shorter than the one around it, which ends the recursion.
    """
    if not PACKED.match(value):
        return None
    for data in unpack(value):
        if len(data) >= len(value):
            continue
        if key_container(data):
            return "key container"
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not text.isprintable() and not all(c.isprintable() or c in "\r\n\t" for c in text):
            continue
        if (m := TOKEN.search(text)) and not PLACEHOLDER.search(m[0]):
            return "encoded token"
        if BLOCK.search(text):
            return "encoded private key"
        if (m := URL.search(text)) and plausible(m[1]) or (m := CONNECTION.search(text)) and plausible(m[1]):
            return "encoded connection"
        for m in ASSIGN.finditer(text):
            if secret_name(m[2]) and (b := BARE.match(text, m.end()) or LITERAL.match(text, m.end())) and plausible(b[0].strip("\"'`")):
                return "encoded assignment"
        if kind := hidden(text.strip()):
            return kind
    return None


# --- scanning -----------------------------------------------------------------------------------------------------


def _pieces(code: str, m: re.Match) -> tuple[str, tuple[tuple[int, int], ...]]:
    """The value of a chain of literals and the spans of the literals' contents."""
    spans = tuple((x.start() + 1, x.end() - 1) for x in LITERAL.finditer(code, m.start(), m.end()))
    return "".join(code[a:b] for a, b in spans), spans


def _suspects(code: str) -> list[tuple[int, int]]:
    """The lines (from, to) worth a look, in order."""
    low = (code if code.isascii() else code.translate(FOLD)).lower()
    if len(low) != len(code):  # a letter grew when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in code.translate(FOLD))
    starts: dict[int, int] = {}
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            end = low.find("\n", at)
            end = len(low) if end < 0 else end
            starts[low.rfind("\n", 0, at) + 1] = end
            at = low.find(word, end)
    for m in LONG.finditer(code):
        a = code.rfind("\n", 0, m.start()) + 1
        if a not in starts:
            b = code.find("\n", a)
            starts[a] = len(code) if b < 0 else b
    return sorted(starts.items())


def scan(code: str | None, path: str | None = None) -> list[Secret]:
    """The credentials in ``code``, at most one a line, in order. Null and empty code have none."""
    if not code:
        return []
    triggered = _suspects(code)
    found: dict[int, Secret] = {}
    skip_to = -1
    config = bool(path) and bool(re.search(r"(?i)\.(?:env|ya?ml|ini|cfg|conf|properties|toml|sh|bash|zsh|tfvars)$|(?:^|/)\.env|Dockerfile", path))
    line, at = 1, 0

    def add(kind: str, start: int, *spans: tuple[int, int]) -> None:
        n = line + code.count("\n", at, start)
        if n in found:
            old = found[n]
            new = tuple(s for s in spans if all(s[1] <= o[0] or s[0] >= o[1] for o in old.spans))
            found[n] = old._replace(spans=old.spans + new)
        else:
            found[n] = Secret(n, kind, spans)

    for a, b in triggered:
        line, at = line + code.count("\n", at, a), a
        if a < skip_to:
            continue
        text = code[a:b]
        if m := BLOCK.search(text):
            end = BLOCK_END.search(code, a + m.end())
            stop = end.start() if end else len(code)
            body, last = (), a + m.end()
            for x in BODY.finditer(code, a + m.end(), stop):  # as far as the block goes, which may lack an end
                if not BETWEEN.fullmatch(code, last, x.start()):
                    break
                body, last = (*body, x.span()), x.end()
            stop = stop if end and BETWEEN.fullmatch(code, last, stop) else last
            if sum(y - x for x, y in body) >= 32:
                add("private key", a + m.start(), *body)
                skip_to = stop
                continue
        for m in TOKEN.finditer(text):
            if not PLACEHOLDER.search(m[0]) and len(set(m[0])) > 8:
                add("token", a + m.start(), (a + m.start(), a + m.end()))
        for kind, p in (("url", URL), ("header", HEADER), ("header", KEYHEADER), ("command", COMMAND), ("connection", CONNECTION), ("spoken", SPOKEN)):
            for m in p.finditer(text):
                k = next(i for i in range(1, p.groups + 1) if m[i] is not None)
                v = m[k]
                if plausible(v, 4 if kind in ("url", "command") else 6) and not (kind == "spoken" and (_classes(v) < 3 or not re.search(r"\d", v) or re.search(r"[()]", v))):
                    add(kind, a + m.start(k), (a + m.start(k), a + m.end(k)))
        for kind, p in (("login", CALL), ("fallback", FALLBACK)):
            for m in p.finditer(text):
                k = p.groups
                if plausible(m[k][1:-1]) and (kind == "login" or secret_name(m[1])):
                    add(kind, a + m.start(k), (a + m.start(k) + 1, a + m.end(k) - 1))
        for m in CHAIN.finditer(code, a):
            if m.start() >= b:
                break
            value, spans = _pieces(code, m)
            if len(spans) > 1 and (t := TOKEN.search(value)) and not PLACEHOLDER.search(t[0]) and len(set(t[0])) > 8:
                add("joined token", m.start(), *spans)
            elif len(value) >= 12 and not value.startswith(("data:", "sha")) and (kind := hidden(value)):
                add(kind, m.start(), *spans)
        for p in (ASSIGN, DEFINE):
            for m in p.finditer(text):
                name = m[p.groups]
                if not secret_name(name):
                    continue
                if c := CHAIN.match(code, a + m.end()):
                    value, spans = _pieces(code, c)
                    if plausible(value):
                        add("assignment", c.start(), *spans)
        if config and (m := SCALAR.match(text)) and (kind := hidden(m[1])):
            add(kind, a + m.start(1), (a + m.start(1), a + m.end(1)))
        if (m := CONFIG_LINE.match(text)) and secret_name(m[1]) and (config or not re.search(r"[;(){}]\s*$", text)):
            v = text[m.end() :]
            v = re.split(r"[ \t]+#", v, maxsplit=1)[0].rstrip()
            if v and not re.search(r"[()\s\"'`{}]|;$|,$", v) and (config or not re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", v)) and plausible(v):
                add("setting", a + m.end(), (a + m.end(), a + m.end() + len(v)))
    return [found[n] for n in sorted(found)]


def redact(code: str | None, path: str | None = None, mask: str = MASK) -> str | None:
    """``code`` with the value of every credential replaced by ``mask`` and nothing else changed; null stays null."""
    if not code:
        return code
    spans = sorted({s for x in scan(code, path) for s in x.spans})
    out, at = [], 0
    for a, b in spans:
        if a < at:
            continue
        out += [code[at:a], mask]
        at = b
    return "".join([*out, code[at:]])


FOUND = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType())]))


@F.pandas_udf(FOUND)
def _found(codes, paths):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([[(x.line_no, x.kind) for x in scan(c, p)] for c, p in zip(codes, paths, strict=True)])


@F.pandas_udf(T.StringType())
def _redacted(codes, paths):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([redact(c, p) for c, p in zip(codes, paths, strict=True)])


def find_credentials(symbols: DataFrame) -> DataFrame:
    """(id, line_no, kind): one row for each line of a current ``source_code`` on which a credential begins.

    All versions are scanned where they lie and only what was found is shuffled to pick the current row of each id.
    Null and empty code give no rows.
    """
    from graphloom.operators.versions import latest

    found = F.when(F.length("source_code") > 0, _found(F.col("source_code"), F.col("file_path")))
    rows = latest(symbols, "id", "updated_at", found.alias("found"))
    return rows.select("id", F.explode("found").alias("f")).select("id", "f.line_no", "f.kind")


def redacted(symbols: DataFrame) -> DataFrame:
    """(id, source_code): the current code of every symbol with its credentials masked; null code stays null."""
    from graphloom.operators.versions import latest

    rows = latest(symbols, "id", "updated_at", "source_code", "file_path")
    return rows.select("id", _redacted("source_code", "file_path").alias("source_code"))


CHECKED = T.StructType([T.StructField("clean", T.BooleanType()), T.StructField("kept", T.BooleanType())])


@F.pandas_udf(CHECKED)
def _checked(codes, paths):  # noqa: ANN001, ANN202
    import pandas as pd

    rows = []
    for c, p in zip(codes, paths, strict=True):
        out = redact(c, p)
        spans = sorted({s for x in scan(c, p) for s in x.spans}) if c else []
        at, kept, pos = 0, True, 0
        for a, b in spans:  # what stands between the secrets stands between the masks
            if a < at:
                continue
            kept = kept and out[pos : pos + a - at] == c[at:a] and out[pos + a - at :].startswith(MASK)
            pos, at = pos + a - at + len(MASK), b
        kept = kept and (out or "")[pos:] == (c or "")[at:]
        rows.append((not scan(out, p), kept and (out is None) == (c is None)))
    return pd.DataFrame(rows, columns=["clean", "kept"])


def redaction_check(symbols: DataFrame) -> DataFrame:
    """(id, clean, kept): whether the redacted code of each symbol has no credential left, and nothing but credentials changed."""
    from graphloom.operators.versions import latest

    return latest(symbols, "id", "updated_at", _checked(F.col("source_code"), F.col("file_path")).alias("c")).select("id", "c.clean", "c.kept")
