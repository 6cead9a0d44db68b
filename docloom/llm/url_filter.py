"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The vocabulary is looked for in the whole url after its scheme: host, path, query and fragment, with percent codes read.
A term counts only between boundaries (no letter or digit next to it). One strict term, or SOFT_LIMIT distinct soft
terms, block a page; all else is allowed.
"""

from __future__ import annotations

from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: rules as (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# fixed values: the vocabulary
STRICT = tuple(
    "adult porn porno pornos pornography xxx sex sexcam sexchat sexshop nude nudes nudity nsfw milf hentai erotic erotica erotik camgirl camgirls escort escorts hooker "
    "hookers gangbang blowjob bdsm creampie upskirt casino gambling gamble glücksspiel viagra cialis levitra kamagra tramadol xanax oxycontin phentermine warez "
    "keygen keygens nulled malware ransomware spyware phishing botnet carding fullz spam spammer spammers".split()
)
SOFT = tuple(
    "ads adserver affiliate affiliates bet bets betting bingo bitcoin blackjack bonus cam cams cheap clearance click clicks clickbank crack cracked cracks credit dating deal "
    "deals diet discount discounts download downloads earn ebay farm fetish free freebie freebies gratis hack hacks hot hottest jackpot leaked loan loans lottery "
    "lotto luck lucky mortgage naked nulls offer offers payday pharma pharmacy pill pills poker popup prize prizes promo promos promotion rabatt replica replicas roulette "
    "sale serial serials sexy singles slot slots steroids streaming swingers tabs torrent torrents track tracker tracking win winner winners winning".split()
)
SOFT_LIMIT = 2


def find_terms(urls: list[str], automaton) -> tuple[list[int], list[int]]:
    """Distinct strict and soft terms between boundaries in each text, in lower case and with its percent codes read."""
    strict, soft = [], []
    for text in urls:
        found, text = set(), unquote(text).lower()
        for end, (term, hard) in automaton.iter(text):
            start = end - len(term) + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                found.add((hard, term))
        n = sum(hard for hard, _ in found)
        strict.append(n)
        soft.append(len(found) - n)
    return strict, soft


def build(strict=STRICT, soft=SOFT):
    automaton = ahocorasick.Automaton()
    for term in soft:
        automaton.add_word(term, (term, False))
    for term in strict:
        automaton.add_word(term, (term, True))
    automaton.make_automaton()
    return automaton


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits) for every row of pages (page_id, url).

    The longest rule that fits decides; it is written host + path. Host: after the first :// up to / ? # or the end, A-Z
    lower-cased; path: then up to ? # or the end. A null url, or one without ://, has an empty host and path, fits no
    rule; its terms, if any, count as in others. Repeated rows are judged each; an empty table gives an empty result.
    """
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    whole = F.coalesce(F.when(F.instr("url", "://") > 0, rest).otherwise(F.col("url")), F.lit(""))
    df = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"), whole.alias("whole")).select(
        "page_id",
        "whole",
        F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )

    def scan(batches):
        automaton = build(strict, soft)
        for batch in batches:
            a, b = find_terms(batch.column("whole").to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["page_id", "host", "path", "strict_hits", "soft_hits"])

    kind = dict(df.dtypes)["page_id"]
    df = df.mapInArrow(scan, f"page_id {kind}, host string, path string, strict_hits long, soft_hits long")
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    for h, p, v in reversed(by_length):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_hits")


def oracle() -> str:
    """DuckDB's statement of the same result."""
    by_length = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in by_length]
    rule = " ".join(f"WHEN {c} THEN '{h}{p}'" for c, (h, p, _) in zip(fits, by_length, strict=True))
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, (_, _, v) in zip(fits, by_length, strict=True))

    def hits(terms):
        return " + ".join(rf"regexp_matches(u, '(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])')::BIGINT" for t in terms)

    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         lower(url_decode(coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END, ''))) AS u FROM pages),
parts AS (SELECT page_id, u, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
found AS (SELECT *, {hits(STRICT)} AS strict_hits, {hits(SOFT)} AS soft_hits FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits
FROM found"""
