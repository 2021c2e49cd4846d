"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and path rule (``allow example.com/en/``) or a wildcard pattern
(``block ||ads.*^``). Each becomes one regular expression over ``host + path``.
Its literal tokens are the runs of ``[a-z0-9]`` that must appear in any url it
fits. One pass over all urls counts how often each rule token occurs; each rule is
filed under its rarest one. Judging a url looks up its own tokens and runs only the
expressions filed under them, so the work per url follows the few rules that share
a rare token with it and not the size of the list.

The counts that come to the driver are one row per rule token; the list itself is
the caller's parameter and travels with the task. No shuffle beyond those counts.

Host and path rules decide first, the longest fitting rule wins (ties: block).
Else patterns decide: block if a block pattern fits and no allow pattern does.
Else the verdict is allow. A null url, or one without ``://``, has empty host and
path. Repeated rows give repeated rows; columns that share an output's name are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z0-9]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: The host and path rules of the contract (fixed values).
HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Wildcard patterns for urls that no host and path rule fits: ``||`` a label's
#: start, ``^`` a separator or the end, ``*`` anything.
PATTERN_RULES = (
    ("block", "||spam-farm.*"),
    ("block", "||adult-x.*"),
    ("block", "||casino.*"),
    ("block", "||porn^"),
    ("block", "||malware^"),
    ("block", "/phishing/*"),
    ("block", "/adserver/*"),
    ("block", "/wp-login.php^"),
    ("block", "/cgi-bin/redirect*"),
    ("allow", "||about.casino.example.org^"),
)


@dataclass(frozen=True)
class Rule:
    """A compiled rule; ``rule`` is None for a wildcard pattern."""

    action: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    is_host: bool


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(UPPER), slash + path


def host_rule(action: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    host = host.translate(UPPER)
    path = slash + path
    # The last run of a path prefix may go on in the url, so it is no whole token.
    tokens = TOKEN.findall(host) + TOKEN.findall(re.sub(r"[a-z0-9]+$", "", path.translate(UPPER)))
    return Rule(action, host + path, rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def pattern_rule(action: str, text: str) -> Rule:
    body, out = text, ""
    if body.startswith("||"):
        body, out = body[2:], r"\A(?:[^/]*\.)?"
    for c in body:
        out += ".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\z)" if c == "^" else re.escape(c)
    # A run counts as a whole token if neither a wildcard nor an open end touches it.
    closed = text if text[-1] in "*^" or not text[-1].isalnum() else text + "*"
    whole = re.sub(r"[a-z0-9]*\*[a-z0-9]*", " ", closed.translate(UPPER))
    whole = whole if text.startswith("|") or not text[0].isalnum() else re.sub(r"^[a-z0-9]+", "", whole)
    return Rule(action, text, "(?s)" + out.replace(r"\z", r"\Z"), tuple(TOKEN.findall(whole)), False)


def compile_rules(host_rules: Iterable = HOST_RULES, pattern_rules: Iterable = PATTERN_RULES) -> list[Rule]:
    return [host_rule(*r) for r in host_rules] + [pattern_rule(*r) for r in pattern_rules]


def token_counts(urls: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """How many urls hold each rule token: one row per token of the rule list."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("([a-z0-9]+)"), F.lit(1)))
    own = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    return {r["token"]: r["n"] for r in urls.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest token; those without a token under None, always run."""
    out: dict[str | None, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if r.tokens else None, []).append(r)
    return out


class Judge:
    """Looks up a url's candidate rules and runs only their expressions."""

    def __init__(self, index: dict[str | None, list[Rule]]):
        self.index = {k: [(re.compile(r.regex), r) for r in v] for k, v in index.items()}

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        target = host + path
        found = [r for token in (None, *dict.fromkeys(TOKEN.findall(target.translate(UPPER)))) for x, r in self.index.get(token, ()) if x.search(target)]
        hosts = [r for r in found if r.is_host]
        if hosts:
            best = max(hosts, key=lambda r: (len(r.text), r.action == "block"))
            return host, path, best.text, best.action, None
        fits = sorted(r.text for r in found if r.action == "allow") or sorted(r.text for r in found)
        allowed = not found or any(r.action == "allow" for r in found)
        return host, path, None, "allow" if allowed else "block", fits[0] if fits else None


def judge(df: DataFrame, url: str = "url", host_rules: Iterable = HOST_RULES, pattern_rules: Iterable = PATTERN_RULES) -> DataFrame:
    """The operator: ``df`` with host, path, rule, verdict and pattern added."""
    made = ["host", "path", "rule", "verdict", "pattern"]
    rules = compile_rules(host_rules, pattern_rules)
    index = index_rules(rules, token_counts(df, url, rules))
    kept = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType(kept + [T.StructField(c, T.StringType()) for c in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Judge(index)
        for b in batches:
            rows = [one(u) for u in b.column(b.num_columns - 1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(made))]
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + columns, names=[f.name for f in kept] + made)

    return df.select(*[df[f.name] for f in kept], F.col(url).cast("string").alias("__url")).mapInArrow(run, schema)


def judge_sql(table: str, key: str = "page_id", url: str = "url") -> str:
    """The same for DuckDB, with the default rules and no index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fit = lambda r: f"regexp_matches(host || path, {quote(r.regex.replace(chr(92) + 'Z', chr(92) + 'z'))})"
    rules = compile_rules()
    hosts = sorted((r for r in rules if r.is_host), key=lambda r: (-len(r.text), r.action != "block"))
    which = lambda value: "case " + " ".join(f"when {fit(r)} then {quote(value(r))}" for r in hosts) + " end"
    fits = lambda action: "list_sort(list_filter([" + ", ".join(f"case when {fit(r)} then {quote(r.text)} end" for r in rules if not r.is_host and r.action == action) + "], lambda x: x is not null))"
    return f"""
with parts as (
    select {key}, coalesce(case when strpos({url}, '://') > 0 then regexp_replace(substr({url}, strpos({url}, '://') + 3), '(?s)[?#].*', '') end, '') as rest from {table}),
split as (
    select {key}, translate(case when strpos(rest, '/') > 0 then left(rest, strpos(rest, '/') - 1) else rest end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path from parts),
judged as (
    select *, {which(lambda r: r.text)} as rule, {which(lambda r: r.action)} as action, {fits('allow')} as allowed, {fits('block')} as blocked from split)
select {key}, host, path, rule,
       coalesce(action, case when len(blocked) > 0 and len(allowed) = 0 then 'block' else 'allow' end) as verdict,
       case when rule is null then coalesce(allowed[1], blocked[1]) end as pattern
from judged"""
