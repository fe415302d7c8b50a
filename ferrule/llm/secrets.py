"""Credentials in source and configuration texts, found and masked (problem 7).

Every line is cut into lexical tokens, and a linear-chain conditional random field
labels every token as part of a credential or not from its shape, its neighbours
and the names before it; a line after an open assignment is read together with it. The Viterbi path gives the exact characters to
mask. The field is trained here, on lines written from the templates below; no row
of the data takes part in the fit, and every line of the data is treated alike.
"""

from __future__ import annotations

import functools
import keyword
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training lines written from the templates, and hashed feature slots.
TRAINING_LINES, SLOTS = 5000, 1 << 15
SECRET_TOKEN = re.compile(
    r"""-----(?:BEGIN|END)[ ][A-Z0-9 ]+-----|://|\\[nrt]|\"{3}|'{3}|["'`]|(?:[A-Za-z0-9_+/.\-$#%!&*^~?]|[^\x00-\x7f]|(?<=[A-Za-z0-9+/]{16})={1,2}(?=["'`\s;,)]|$)|(?<=[A-Za-z0-9+/]{16}=)=(?=["'`\s;,)]|$))+|\S"""
)
# Words of names that hold credentials, of names that hold harmless digests or ids, and of look-ups.
CREDENTIAL_WORDS = {"pass", "passwd", "password", "passphrase", "pwd", "pw", "pin", "secret", "token", "key", "apikey", "accesskey", "auth", "authorization", "credential", "credentials", "cred", "bearer", "signing", "private", "login", "smtppassword", "authtoken", "basic", "dsn"}
HARMLESS_WORDS = {"sha", "sha1", "sha256", "sha512", "md5", "crc", "checksum", "digest", "hash", "commit", "revision", "rev", "etag", "uuid", "guid", "request", "id", "trace", "span", "public", "pub", "fingerprint", "integrity", "version", "nonce", "hint", "label", "message", "help", "index", "cursor", "count", "limit", "stream", "prefix", "name", "url", "path"}
LOOKUP_WORDS = {"env", "environ", "getenv", "vault", "config", "settings", "process", "secrets", "keyring", "prompt", "getpass", "input"}
PLACEHOLDER = re.compile(r"^<|>$|example|change_?me|your[-_]|^your|insert|x{4,}|\*{3,}|dummy|placeholder|redacted|sample|^test$|^none$|^null$|^todo$|^todo\b|^password$|^secret$|^token$|^foo|^bar$|^abc|^1234|^\.\.\.|^\$\{|^%\(|^replace", re.I)
KNOWN_PREFIX = re.compile(r"^(gh[pousr]_|github_pat_|glpat-|AKIA|ASIA|xox[abprs]-|sk_live_|rk_live_|sk-|eyJ|AIza|ya29\.|npm_|pypi-|SG\.|hf_|dop_v1_)")
# What plain credential lines have; nothing is filtered by it.
GATE = r"(?i)(passw|passphrase|(^|[^a-z])pass([^a-z]|$)|pwd|[^a-z]pw([^a-z]|$)|secret|token|api_?key|access_?key|key[_0-9]*['\"]?\s*[:=]|auth|credential|bearer|private key|login|://[^/\s:@]*:[^/\s@]+@|gh[pousr]_|github_pat|glpat-|akia[0-9a-z]{12}|asia[0-9a-z]{12}|xox[abprs]-|sk_live_|rk_live_|eyj[0-9a-z_-]{10}|aiza[0-9a-z])"
GATE_VALUE = r"[\"'`][^\"'`\s]{4,}|[=:]\s*[^\s\"'`(){}\[\],;]{6,}|-----BEGIN|--\w+[ =]\S{4,}|[Bb]asic |[Bb]earer "
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")


def subwords(token: str) -> list[str]:
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+\d*|\d+", token)]


@functools.lru_cache(1 << 16)
def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def kind(token: str) -> str:
    """A coarse shape of a token."""
    if PLACEHOLDER.search(token):
        return "placeholder"
    if PEM_BEGIN.fullmatch(token):
        return "pem"
    if token.startswith("-----"):
        return "pemother"
    if KNOWN_PREFIX.match(token) and len(token) >= 16:
        return "known"
    if re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", token, re.I):
        return "uuid"
    if re.fullmatch(r"[0-9a-f]{24,}", token, re.I) and re.search(r"\d", token):
        return "hex"
    if re.fullmatch(r"[\d.,]+", token):
        return "number"
    if not re.search(r"\w", token):
        return "punct"
    if re.fullmatch(r"[a-z]+([-_.][a-z]+)*", token) or re.fullmatch(r"[A-Z]?[a-z]+|[A-Z]+", token):
        return "word"
    if re.fullmatch(r"[a-z]+[-_.]?\d(?:[-_.]?\d)*", token):
        return "wordnum"
    if re.fullmatch(r"[A-Za-z0-9]{8,24}", token) and sum(len(w) < 3 or not re.search("[aeiouy]", w) for w in subwords(token)) >= 2:
        return "odd"
    if re.fullmatch(r"[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*", token) and not (len(token) >= 10 and re.search(r"\d[^A-Za-z]*[A-Za-z]\D*\d|[a-z]\d+[A-Z]|[A-Z]{2}[a-z]+[A-Z]+[a-z]*\d", token)) and entropy(token) < 4.2:
        return "ident"
    if len(token) >= 20 and entropy(token) > 3.6:
        return "random"
    if re.search(r"\d", token) and re.search(r"[A-Za-z]", token) and re.search(r"[A-Z$#%!&*^~?@+]", token) and len(token) >= 6:
        return "strong"
    return "mixed" if re.search(r"\d", token) and re.search(r"[A-Za-z]", token) else "other"


def name_class(words: list[str]) -> str:
    if any(w in HARMLESS_WORDS for w in words):
        return "harmless+" if any(w in CREDENTIAL_WORDS for w in words) else "harmless"
    if any(w in LOOKUP_WORDS for w in words):
        return "lookup"
    return "credential" if any(w in CREDENTIAL_WORDS for w in words) else "none"


class Facts:
    """What a token says by itself."""

    __slots__ = ("bits", "dash", "entropy", "flag", "kind", "klass", "named", "quote", "remark", "short", "size", "stops", "words")

    def __init__(self, t: str) -> None:
        words = subwords(t)
        self.kind, self.words = kind(t), tuple(words)
        self.klass = name_class(words)
        self.bits = any(w in HARMLESS_WORDS for w in words) | any(w in LOOKUP_WORDS for w in words) << 1 | any(w in CREDENTIAL_WORDS for w in words) << 2
        self.named = self.kind in ("word", "ident", "wordnum", "mixed", "placeholder") and len(t) > 1 and bool(re.match(r"[-A-Za-z_$]", t))
        self.flag = next((w for w in words if w in CREDENTIAL_WORDS), "-")
        self.dash = t.startswith("-")
        self.size = "s" if len(t) < 4 else "m" if len(t) < 8 else "l" if len(t) < 16 else "x" if len(t) < 200 else "blob"
        self.entropy = int(entropy(t))
        self.short = t if len(t) < 3 else ""
        self.quote = t in ('"', "'", "`", '"""', "'''")
        self.remark = 2 if t == "#" or t.startswith("//") or t in ("/*", "*") else int(t.startswith("#"))  # 1: only as first token
        self.stops = t == "@" or bool(re.fullmatch(r"\s|[\"'`]", t))


facts = functools.lru_cache(1 << 17)(Facts)
#: Class of several names together, by the bits of all: harmless 1, look-up 2, credential 4.
JOINT = ["none", "harmless", "lookup", "harmless", "credential", "harmless+", "lookup", "harmless+"]


def contexts(tokens: list[str]) -> Iterator[tuple[tuple, tuple, tuple]]:
    """Of each token what its features read: its shape among names and quotes, its neighbours, the names before it."""
    seen = [facts(t) for t in tokens]
    quote, comment, url, names = "", False, 0, []
    end, n = "$", len(seen)
    for i, f in enumerate(seen):
        prior = seen[i - 1] if i else None
        before = (prior.short or prior.kind) if prior else "^"
        after = (seen[i + 1].short or "t") if i + 1 < n else end
        two = (seen[i - 2].short or seen[i - 2].kind) if i > 1 else "^"
        last = names[-1] if names else None
        klass = last.klass if last else "none"
        near = "none"
        if names:
            bits = 0
            for m in names[-4:]:
                bits |= m.bits
                if m.klass == "credential":
                    near = "credential"
            if near == "none":
                near = JOINT[bits]
        login = url == 1 and before == ":" and after == "@"
        flag = prior.flag if prior and (prior.dash or prior.kind == "word" and quote) else "-"
        yield (f.kind, klass, near, bool(quote), comment, f.size, login, url, flag, f.entropy), (f.kind, before, klass, after), (f.kind, last.words[-2:] if last else (), two)
        if f.quote:
            t = tokens[i]
            quote = "" if quote == t else quote or t
        elif not quote and f.remark and (f.remark == 2 or i == 0):
            comment = True
        if tokens[i] == "://":
            url = 1
        elif f.stops:
            url = 0
        if f.named:
            names.append(f)


def slots(group: int, key: tuple) -> list[int]:
    """Hashed features of one of the three contexts of a token."""
    if group == 0:
        k, klass, near, quoted, comment, size, login, url, flag, ent = key
        fs = ("b", f"k={k}", f"k={k}|n={klass}", f"k={k}|near={near}", f"k={k}|q={quoted}|c={comment}", f"k={k}|size={size}", f"login={login}", f"login={login}|k={k}", f"url={url}|k={k}", f"flag={flag}", f"flag={flag}|k={k}", f"ent={ent}|n={klass}|size={size}", f"n={klass}|near={near}|k={k}")
    elif group == 1:
        k, before, klass, after = key
        fs = (f"pb={before}", f"k={k}|pb={before}|n={klass}", f"pa={after}|pb={before}")
    else:
        k, last, two = key
        fs = (f"w={'.'.join(last)}", f"w={last[-1] if last else ''}|k={k}", f"two={two}|k={k}")
    return [zlib.crc32(f.encode()) % SLOTS for f in fs]


def features(tokens: list[str]) -> list[list[int]]:
    """Hashed shape and context features of each token."""
    return [[s for g, key in enumerate(keys) for s in slots(g, key)] for keys in contexts(tokens)]


class Field:
    """Weights of the two-label chain: ``emit[slot, label]``, ``move[label, label]``.

    By how much a context speaks for label 1 is added up once and kept, so a token costs three look-ups.
    """

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move
        self.known: tuple[dict, dict, dict] = ({}, {}, {})

    def __reduce__(self) -> tuple:
        return Field, (self.emit, self.move)

    def path(self, leads: list[float]) -> list[int]:
        """The Viterbi path, from the lead of label 1 over label 0 at each token."""
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one, back = 0.0, leads[0], []
        for d in leads[1:]:
            from0, from1 = one + m10 > zero + m00, one + m11 > zero + m01
            back.append((from0, from1))
            zero, one = one + m10 if from0 else zero + m00, (one + m11 if from1 else zero + m01) + d
        path = [int(one > zero)]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def label(self, feats: list[list[int]]) -> list[int]:
        """Labels of tokens given by their features."""
        return self.path([float((self.emit[f, 1] - self.emit[f, 0]).sum()) for f in feats])

    def label_tokens(self, tokens: list[str]) -> list[int]:
        """Labels of the tokens of a line."""
        leads = []
        for keys in contexts(tokens):
            total = 0.0
            for g, (key, known) in enumerate(zip(keys, self.known, strict=True)):
                got = known.get(key)
                if got is None:
                    if len(known) > 200_000:
                        known.clear()
                    at = slots(g, key)
                    got = known[key] = float((self.emit[at, 1] - self.emit[at, 0]).sum())
                total += got
            leads.append(total)
        return self.path(leads)


def train(lines: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum conditional likelihood by Adam over all lines.

    The lines lie longest first and position by position, so that forward and backward
    take the lines that are still open as one slice. The weights of the two labels mirror
    each other from zero on; only those of label 1 are kept.
    """
    n, lines = len(lines), sorted(lines, key=lambda x: -len(x[1]))
    width = len(lines[0][1])
    open_ = [sum(len(y) > t for _, y in lines) for t in range(width)]
    at = np.concatenate([[0], np.cumsum(open_)])
    flat = np.array([lines[i][0][t] for t in range(width) for i in range(open_[t])], np.int32)
    gold = np.array([lines[i][1][t] for t in range(width) for i in range(open_[t])], np.int64)
    last = np.array([at[len(y) - 1] + i for i, (_, y) in enumerate(lines)])
    weight, move = np.zeros(SLOTS), np.zeros((2, 2))
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(move), np.zeros_like(move)]
    moved = np.zeros((2, 2))
    for t in range(1, width):
        m = open_[t]
        np.add.at(moved, (gold[at[t - 1] : at[t - 1] + m], gold[at[t] : at[t + 1]]), 1)
    for r in range(1, rounds + 1):
        s = weight[flat].sum(1)
        s = np.stack([-s, s], 1)
        a, b = s.copy(), np.zeros_like(s)
        for t in range(1, width):
            m, before = open_[t], a[at[t - 1] : at[t - 1] + open_[t]]
            a[at[t] : at[t + 1]] += np.logaddexp(before[:m, :1] + move[0], before[:m, 1:] + move[1])
        gm = -moved
        total = np.logaddexp(a[last, 0], a[last, 1])
        for t in range(width - 2, -1, -1):
            m = open_[t + 1]
            x = s[at[t + 1] : at[t + 2]] + b[at[t + 1] : at[t + 2]]
            mine = slice(at[t], at[t] + m)
            b[mine] = np.logaddexp(move[:, 0] + x[:, :1], move[:, 1] + x[:, 1:])
            gm = gm + np.exp(a[mine][:, :, None] + move + x[:, None, :] - total[:m, None, None]).sum(0)
        each = np.concatenate([np.arange(m) for m in open_])
        diff = (np.exp(a[:, 1] + b[:, 1] - total[each]) - gold) / n
        g = np.bincount(flat.ravel(), np.repeat(diff, flat.shape[1]), SLOTS) + decay * weight
        for w, grad, m, v in ((weight, g, *moments[:2]), (move, gm / n, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            w -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(np.stack([-weight, weight], 1).astype(np.float32), move)


# Templates of training lines. {S} stands for a credential, {H} for a digest or id, {P} for a placeholder, {N} for a
# credential's name, {V} for a harmless value, {I} for an identifier, {W} for a word, {C} for a harmless name.
POSITIVE = r'''
{N} = "{S}"
{N} = '{S}'
const {N} = '{S}';
let {N}_{D} = "{S}";
var {N} = "{S}";
  {N}: '{S}',
{N}: {S}
{N}={S}
export {N}="{S}"
export {N}={S}
# {N}: {S}
// {N} = {S}
# old {N}, still valid: {S}
// the {N} of {W} is {S}
# {N} until friday: {S}
{W}_{N} = {S}
{I} = {{"{N}": "{S}", "{I}": {D}}}
{I} = {{'{I}': {D}, '{N}': '{S}'}};
{I} = os.environ.get('{N}', '{S}')
const {I} = process.env.{N} || '{S}';
{I} = os.getenv("{N}") or "{S}"
headers = {{"Authorization": "Bearer {S}"}}
headers = {{'Authorization': 'Token {S}'}}
var headers_{D} = {{"Authorization": "ApiKey {S}"}};
headers["X-Api-Key"] = "{S}"
{I} = "Authorization: Basic {S}"
curl -H 'Authorization: Basic {S}' https://{W}.example/{W}
Authorization: Bearer {S}
{I} = "{W} --user {W} --password {S}"
cmd = '{W} --{I} {W} --pass {S}'
cmd = "{W} -u {W} --secret {S} --verbose"
run("{W} login --token {S}")
{I} = "postgres://{W}:{S}@{W}.{W}.example/{W}"
{N} = 'amqp://{W}:{S}@{W}.example/{W}'
{I} = "mongodb+srv://{W}:{S}@{W}.{W}.example/{W}"
{N} = 'mongodb+srv://{W}:{S}@{W}.example/{W}'
DATABASE_URL=mysql://{W}:{S}@{W}.internal/{W}
url: https://{W}:{S}@{W}.example.com/{W}.git
const {I} = "redis://{W}:{S}@{W}.example/{W}";
{I} = {I}('{W}', {N}='{S}')
connect(user="{W}", {N}="{S}")
{N} = '{S}' + '{S}'
let {N}_{D} = "{S}" + "{S}";
{N} = """{B}
{N} = "{B}\n{S}\n{S}"
var {N} = '{B}\n{S}\n{S}
{B}
  {B}
const {I} = `{B}
  {N}: "{S}"
"{N}": "{S}",
self.{N} = "{S}"
this.{N} = '{S}';
assert {I}("{S}", {N}="{S}")
'''.strip("\n").split("\n")
NEGATIVE = r'''
{N} = "{P}"
const {N} = '{P}';
{N}={P}
{N}: {P}
{N} = "<insert {N} here>"
{N} = '<your-{N}>'
var {N}_{D} = "<{N}>";
{N} = ''
const {N} = "";
{N} = os.environ["{N}"]
{N} = os.environ.get("{N}")
const {N} = process.env.{E};
{N} = get_secret("{W}/{N}")
{N} = vault.read('{W}/{W}')
# {N} is read from the vault
// {N} comes from the environment
{C} = "{H}"
const {C} = '{H}';
{C}: {H}
{C}={H}
{C}_{D} = "{H}";
let {C} = "{H}"
"{C}": "{H}",
# {C}: {H}
token = "{V}"
const token = '{V}';
token_{D} = '{V}'
let token = "{V}";
key = '{V}'
{I} = "password must have {D} characters"
hint = 'the token is too short'
const hint_{D} = "password must have {D} characters";
raise ValueError("bad {N} for {W}")
pub = "-----BEGIN PUBLIC KEY-----
const pub_{D} = `-----BEGIN PUBLIC KEY-----
-----BEGIN CERTIFICATE-----
-----END RSA PRIVATE KEY-----"
-----END PUBLIC KEY-----
{I} = "postgres://user:password@localhost/{W}"
dsn = 'postgres://user:password@localhost/dev'
const dsn_{D} = "mysql://root:example@localhost/{W}";
url = "https://{W}.example.com/{W}?page={D}"
{I} = 'http://localhost:{D}/{W}'
def {I}({N}, {I}=None):
function {I}({N}, {I}) {{
if {N} is None: return {I}
{I} = {I}({N}, limit={D})
const {I} = {I}(opts, {{ limit: {D}, {I}: '{W}' }});
import {{ {I} }} from './{W}';
{I} = {I}["{W}"]
for token in {I}({W}):
"""Checks the token of the {W} and returns a key."""
{I}.append({{"{W}": {D}, "token": {I}}})
{I} = re.sub(r"[a-z]+", "{W}", {N})
logger.info("{W} token %s", {I})
author = "{W} {W}"
auth_url = "https://{W}.example/{W}"
key = lambda {I}: {I}.{W}
tokens = {I}.split("{W}")
{N} = request.headers["{W}"]
{N} = input("{N}: ")
password_field = "{W}"
secret_name = "{W}/{V}"
token_type = "{W}"
{I}: {D}
{I}_{W} = "{W}"
{E}_{E}={W}
options = {{"{I}": "{V}", "retries": {D}}}
request_id = "{U}"
const request_id = '{U}';
{I} = "{U}"
{I} = "{W}" if {N} else "{W}-{{}}".format({I})
{N} = None
class {I}({I}):
{I} = b'\n\x12{W}.proto'
sessionToken: string;
token: {I},
{W} = "{L}"
const {I} = '{L}';
var {I} = "{L}";
{I} = """{L}
{L}
{I}.token = {I}.{W}(token)
"""{E}-{D}{D}"""
/** {E}-{D}{D} */
 * {E}-{D}
# {E}-{D}{D}
{E}-{D}{D}
{M}
  {M}
!function(n){{"use strict";n.{W}=[{D},{D}]}}(window);var a{D}=n.{W};
{W}.prototype.{W}=function(r,o){{return this._{W}=r||o?r+o:null,this}};
function {W}{D}(r,o){{var i=r.{W};return i?o(i,{D}):r.{W}||"{W}"}}function {W}{D}(r){{return r}}
var b{D}=function(r){{for(var o=0;o<r.length;o++)if(r[o]==={D})return!0;return!1}};
'''.strip("\n").split("\n")
STEMS = "api_key apikey apiKey API_KEY API_TOKEN api_token auth_token authToken AUTH_TOKEN svc_token access_key accessKey ACCESS_KEY secret_key SECRET_KEY client_secret clientSecret signing_key SIGNING_KEY password PASSWORD passwd PASSWD db_pass DB_PASSWORD db_password smtpPassword SMTP_PASSWORD login_pw pwd PWD_ADMIN admin_pwd tls_key private_key PRIVATE_KEY secret SECRET_TOKEN session_secret webhook_secret refresh_token bearer_token credential passphrase encryption_key root_password master_key".split()
HARMLESS = "checksum sha256 sha1 md5 digest commit revision etag request_id trace_id content_hash fingerprint uuid file_hash blob_sha integrity build_id public_key_id span_id cursor_id".split()
WORDS = "river stone cloud harbor maple signal worker window branch packet ledger copper planet garden bridge candle forest mirror engine pocket silver summer winter dragon falcon meteor pepper rocket tunnel velvet".split()


def write_lines(n: int, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of ``n`` lines filled in from the templates."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: r.choice(WORDS)

    def secret() -> str:
        w = word()
        return r.choice([
            lambda: r.choice(["ghp_", "gho_"]) + some(alnum, 36), lambda: "AKIA" + some(alnum[:26] + "234567", 16), lambda: f"xoxb-{some('0123456789', 11)}-{some(alnum, 24)}", lambda: "sk_live_" + some(alnum, 24),
            lambda: f"eyJhbGciOiJIUzI1NiJ9.{some(alnum + '_-', 42)}.{some(alnum + '_-', r.randint(43, 64))}", lambda: some("0123456789abcdef", r.choice([32, 40, 64])), lambda: some(alnum + "+/", r.randint(30, 44)) + r.choice(["", "=", "=="]),
            lambda: some(alnum, r.randint(9, 16)), lambda: some(alnum[:52], r.randint(9, 16)), lambda: some(alnum + "$!%#", r.randint(10, 14)), lambda: f"{w.capitalize()}!{r.randint(2, 99)}{word()}", lambda: f"{w}{r.randint(10, 9999)}#{word().capitalize()}", lambda: f"{w.upper()}_{word()}_{r.randint(10, 9999)}%", lambda: f"{w}{r.randint(100, 9999)}!", lambda: f"{w.capitalize()}-{word()}-{r.randint(10, 999)}$",
        ])()

    def one(template: str, positive: bool) -> tuple[list[str], list[int]]:
        spans, out, i = [], "", 0
        for m in re.finditer(r"\{([A-Z])\}|\{\{|\}\}", template):
            out += template[i : m.start()]
            i = m.end()
            if m[0] in ("{{", "}}"):
                out += m[0][0]
                continue
            c = m[1]
            name = lambda: r.choice(STEMS) if r.random() < 0.8 else f"{word()}_{r.choice(STEMS)}"
            put = {
                "S": secret, "B": lambda: f"-----BEGIN {r.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----", "N": name, "D": lambda: str(r.randint(0, 999)), "W": word, "E": lambda: r.choice([r.choice(STEMS), word()]).upper(), "C": lambda: r.choice(HARMLESS), "V": lambda: r.choice([f"{word()}-{r.randint(1, 999)}", f"{word()}_{r.randint(1, 99)}", f"{word()}{r.randint(1, 99)}", word()]),
                "I": lambda: r.choice([word(), f"{word()}_{word()}", f"{word()}{word().capitalize()}", f"{word().capitalize()}{word().capitalize()}", f"{word()}_{r.choice(['token', 'pass', 'key'])}_{word()}"]), "L": lambda: some(alnum + "+/", r.randint(200, 900)) + r.choice(["", "=", "=="]), "M": lambda: some(alnum + "+/", r.choice([64, 64, 76])) if r.random() < 0.7 else some(alnum + "+/", r.randint(8, 60)) + "=", "U": lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
                "H": lambda: r.choice([some("0123456789abcdef", r.choice([32, 40, 64])), "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))]), "P": lambda: r.choice(["example", "changeme", "xxxxxxxx", "x" * r.randint(6, 20), "<token>", "your-token-here", "todo", "placeholder", "dummy", "********", "none", "...", "redacted"]),
            }[c]()
            if c in "SB":
                spans.append((len(out), len(out) + len(put)))
            out += put
        out = ("    " if r.random() < 0.3 else "") + out + template[i:]
        off = 4 if out.startswith("    ") and not template.startswith("    ") else 0
        toks = [(m[0], m.start()) for m in SECRET_TOKEN.finditer(out)]
        return [t for t, _ in toks], [int(positive and any(a + off <= s < b + off for a, b in spans)) for _, s in toks]

    return [one(r.choice(POSITIVE), True) if r.random() < 0.5 else one(r.choice(NEGATIVE), False) for _ in range(n)]


@functools.lru_cache(1)
def trained() -> Field:
    lines = [(features(t), y) for t, y in write_lines(TRAINING_LINES) if t and len(t) < 60]
    return train(lines)


def spans_of(line: str, field: Field) -> list[tuple[int, int]]:
    """Characters of a line that belong to credentials."""
    toks = [(m[0], m.start(), m.end()) for m in SECRET_TOKEN.finditer(line)]
    if not toks:
        return []
    labels = field.label_tokens([t for t, _, _ in toks])
    return [(s, e) for (t, s, e), y in zip(toks, labels, strict=True) if y and facts(t).kind != "punct"]


#: A line that ends with a name and its assignment: a name and a colon alone on the line, a quoted name and a colon, or a name and an equals sign.
OPEN_ASSIGNMENT = re.compile(r"""(?:(?:^\s*-?\s*([\w$.-]{1,60})|["']([\w$. -]{1,60})["'])\s*:|(?:^|[\s,({\[.])["']?([\w$-]{1,60})["']?\s*(?::\s*[\w\[\]. |]+)?:?(?<![=!<>])=)\s*[(\[]?\s*\\?\s*$""")


def open_name(line: str) -> str:
    """The line if its name waits for a value on the next line, else an empty text."""
    m = OPEN_ASSIGNMENT.search(line[-200:])
    name = m and (m[1] or m[2] or m[3])
    return line if name and not keyword.iskeyword(name) and kind(name) in ("word", "ident", "wordnum", "mixed", "placeholder") else ""


def continued(before: str, line: str, field: Field) -> list[tuple[int, int]]:
    """Characters of a line that belong to credentials, read as the rest of the open line before."""
    lead = before.rstrip(" \t\\") + " "
    return [(s - len(lead), e - len(lead)) for s, e in spans_of(lead + line, field) if s >= len(lead)]


def scan(text: str, hot: list[int], field: Field, known: dict[tuple[str, str], list[tuple[int, int]]]) -> tuple[list[int], str | None]:
    """Lines (from 1) on which a credential begins, and the text with credentials masked, or None if there are none."""
    lines = text.split("\n")
    out, found, until = None, [], -1
    for i in hot:
        if i <= until:
            continue
        line = lines[i].rstrip("\r")
        before = open_name(lines[i - 1].rstrip("\r")) if i else ""
        spans = known.get((before, line))
        if spans is None:
            spans = known[before, line] = continued(before, line, field) if before else spans_of(line, field)
            if len(known) > 100_000:
                known.clear()
        if not spans:
            continue
        found.append(i + 1)
        out = out or list(lines)
        masked = out[i]
        for s, e in spans:
            masked = masked[:s] + "*" * (e - s) + masked[e:]
        if PEM_BEGIN.search(line) and not PEM_END.search(line):  # the key goes on to its end mark
            begin = PEM_BEGIN.search(line).start()
            if "\\n" in line[begin:]:
                end = re.search(r"[\"'`]\s*[;,)]?\s*$", line)
                stop = end.start() if end else len(line)
                masked = out[i][:begin] + "*" * (stop - begin) + out[i][stop:]
            j = i + 1
            while "\\n" not in line[begin:] and j < len(lines):
                body = lines[j].strip()
                m = PEM_END.search(lines[j])
                if m or re.fullmatch(r"[A-Za-z0-9+/=: -]*", body):
                    cut = m.end() if m else len(lines[j].rstrip("\r"))
                    lead = len(lines[j]) - len(lines[j].lstrip())
                    out[j] = lines[j][:lead] + "*" * (cut - lead) + lines[j][cut:]
                    until = j
                    if m:
                        break
                else:
                    break
                j += 1
        elif PEM_BEGIN.search(line):
            b, e = PEM_BEGIN.search(line).start(), PEM_END.search(line).end()
            masked = out[i][:b] + "*" * (e - b) + out[i][e:]
        out[i] = masked
    return found, "\n".join(out) if out else None


def find_credentials(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Credentials of each text.

    Result: ``record_key`` (string), ``lines`` (array of line numbers from 1, on which
    a credential stands or begins) and ``masked`` (the whole text, credential
    characters replaced by as many asterisks), one row per key whose text holds any.
    Null keys and null or empty texts give nothing; of repeated keys the row with the
    greatest ``lines`` counts once; extra columns are not read. Lines end at ``\\n``.
    """
    field = df.sparkSession.sparkContext.broadcast(trained())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for b in it:
            rows = {"record_key": [], "lines": [], "masked": []}
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines, masked = scan(text, [i for i, x in enumerate(text.split("\n")) if x and not x.isspace()], field.value, known)
                if lines:
                    rows["record_key"].append(key)
                    rows["lines"].append(lines)
                    rows["masked"].append(masked)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("record_key", pa.string()), ("lines", pa.list_(pa.int64())), ("masked", pa.string())]))

    src = df.where(F.col(key_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).cast("string").alias("record_key"), F.col(text_col).cast("string").alias("text"))
    found = src.mapInArrow(run, "record_key string, lines array<long>, masked string")
    return found.groupBy("record_key").agg(F.max(F.struct("lines", "masked")).alias("x")).select("record_key", "x.lines", "x.masked")
