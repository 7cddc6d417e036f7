"""Secret scans by a trigram inverted index, in DataFrame operations alone.

``trigram_query`` derives from a rule's regular expression a Boolean query over lower-cased trigrams that every match must
satisfy. ``postings`` stores (trigram, doc_id) for the trigrams that the rules ask for; ``candidates`` intersects the
postings by document and leaves (doc_id, kinds) whose query holds. Only candidates are verified with the expression; rules
without mandatory trigrams (hex runs) scan every text.

The base kinds come first in ``RULES``; the others add spans. Positions are in code points, the end is exclusive. They come
from marking the matches (with control characters, which no rule matches; those of the text itself become another one for
the scan) and adding up the lengths of the pieces.

Defined results: null and empty texts have no spans; rows with equal or null ids are each scanned whole, candidates by id
being a superset; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .marks import marked
from .storage import only, scratch, written


@dataclass(frozen=True)
class Rule:
    """``prefix`` and ``secret`` follow each other; a match of a secret under ``least`` characters is dropped."""

    kind: str
    prefix: str
    secret: str
    least: int = 1
    base: bool = False


RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    # All of a run is taken, so a run of enough characters is what is left of all runs.
    Rule("access", "", r"AKIA[A-Z0-9]{16,}", 20, True),
    Rule("hex", "", r"[0-9a-f]{24,}", 24, True),
    Rule("pem", "", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", "", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", "", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("cloud", "", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", "", r"[a-z][a-z0-9+.-]{1,20}://[^/\x00-\x20:@]{1,100}:[^/\x00-\x20:@]{1,100}@"),
]

#: A set of strings is followed exactly up to this size.
MOST = 64


def trigram_query(pattern: str):
    """A Boolean query that the lower-cased trigrams of every matching text satisfy.

    True (no condition), a trigram, or ("and" | "or", parts).
    """
    parser = re._parser

    def both(a, b):
        return b if a is True else a if b is True else ("and", (a, b))

    def any_of(parts):
        parts = list(dict.fromkeys(parts))
        return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))

    def of_strings(strings):
        out = []
        for s in strings:
            grams = list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
            out.append(True if not grams else grams[0] if len(grams) == 1 else ("and", tuple(grams)))
        return any_of(out)

    def strings_of(op, arg):
        """All strings that an item can match, lower-cased, or None where they are too many."""
        op = str(op)
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN":
            found = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    found.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < MOST:
                    found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return found if len(found) <= 8 else None
        if op == "SUBPATTERN":
            return sequence_strings(arg[-1])
        if op == "BRANCH":
            all_ = [sequence_strings(x) for x in arg[1]]
            return None if None in all_ else set().union(*all_)
        if op == "MAX_REPEAT" and arg[1] <= 1:
            one = sequence_strings(arg[2])
            return None if one is None else one | ({""} if arg[0] == 0 else set())
        return None

    def sequence_strings(items):
        out = {""}
        for op, arg in items:
            s = strings_of(op, arg)
            if s is None or len(out) * len(s) > MOST:
                return None
            out = {a + b for a, b in product(out, s)}
        return out

    def query(items):
        found, run = True, {""}
        for op, arg in items:
            s = strings_of(op, arg)
            if s is not None and len(run) * len(s) <= MOST:
                run = {a + b for a, b in product(run, s)}
                continue
            found, run = both(found, of_strings(sorted(run))), {""}
            name = str(op)
            if s is not None:
                run = s
            elif name == "SUBPATTERN":
                found = both(found, query(arg[-1]))
            elif name == "BRANCH":
                found = both(found, any_of([query(x) for x in arg[1]]))
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                found = both(found, query(arg[2]))
        return both(found, of_strings(sorted(run)))

    return query(list(parser.parse(pattern)))


def _trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id) for every trigram that a rule asks for, in the shared folder."""
    grams = sorted(set().union(*[_trigrams(trigram_query(r.prefix + r.secret)) for r in rules]))
    rows = only(docs, "doc_id", "text").select("doc_id", F.lower("text").alias("text")).where("text is not null")
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("text"), g))
    return written(rows.select(F.explode(held).alias("trigram"), "doc_id"), "trigram-postings")


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(id, kinds): documents whose postings satisfy the query of a rule; a document has at most as many as the rules ask for."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.prefix + r.secret)) is not True}
    present = index.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("trigram").alias("present"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("present")), F.lit(k)) for k, q in asked.items()]))
    return present.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in a text without the marks."""
    marked = F.regexp_replace(text, f"({rule.prefix})({rule.secret})", "\x01$1\x03$2\x02")
    pieces = F.split(marked, "\x01")
    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        before = F.length(F.substring_index(piece, "\x03", 1))
        inside = F.length(F.substring_index(piece, "\x02", 1)) - 1
        span = F.struct(acc["at"].alias("start"), (acc["at"] + inside).alias("end"))
        kept = F.when(inside - before >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(piece) - 2).alias("at"), kept.alias("spans"))

    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)["spans"]


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _scanned(rows: DataFrame, found: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (doc_id, text and others) with spans. Only rows that the bitmap of candidates marks are joined with these."""
    asked = marked(rows, [rows["doc_id"]], found, [found["id"]])
    some = asked.where("_marked").drop("_marked")
    some = some.join(found, some["doc_id"].eqNullSafe(found["id"]), "left").drop("id")
    rows = asked.where("not _marked").drop("_marked").withColumn("kinds", F.lit(None).cast("array<string>")).unionByName(some)
    rows = rows.withColumn("plain", F.translate(F.coalesce("text", F.lit("")), "\x01\x02\x03", "\x04\x04\x04"))
    parts = []
    for rank, rule in enumerate(rules):
        full = trigram_query(rule.prefix + rule.secret) is True
        holds = F.col("plain").rlike(rule.prefix + rule.secret)
        if not full:
            holds = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & holds
        spans = _named(_spans(F.col("plain"), rule), rank, rule.kind)
        parts.append(F.when(holds, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    return rows.withColumn("spans", F.array_sort(F.concat(*parts))).drop("kinds", "plain")


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, text and spans, array<struct<start, rank, kind, end>> in order, per row of ``docs``."""
    return _scanned(only(docs, "doc_id", "text"), _found(docs, rules), rules)


def _found(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    with scratch(docs.sparkSession) as kept:
        return kept(candidates(postings(docs, rules), rules), "candidates")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The contract's columns from ``scan``."""
    base = [r.kind for r in rules if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``[kind]``; overlapping spans become one, named by the first."""
    # Pieces between the merged spans, and their names, from left to right.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        skip = s["end"] <= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        name = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], gap, name)).alias("out"))

    cut = F.aggregate("spans", start, step)
    new = F.when(F.size("spans") > 0, F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_none")).alias("_rest"))
    rows = _scanned(rows, _found(docs, rules), rules).withColumn("text", new)
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the contract's digest per document."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``."""
    parts = []
    for rank, r in enumerate(RULES):
        pattern = f"({r.prefix})({r.secret})".replace("'", "''")
        parts.append(rf"""
        select id, {rank} rank, '{r.kind}' kind, start, start + length(split_part(piece, chr(2), 1)) - 1 as "end"
        from (select id, i, piece, sum(case when i = 1 then length(piece) else length(piece) - 2 end) over (partition by id order by i) - (length(piece) - 2) start
              from (select id, unnest(string_split(marked, chr(1))) piece, generate_subscripts(string_split(marked, chr(1)), 1) i
                    from (select id, regexp_replace(plain, '{pattern}', chr(1) || '\1' || chr(3) || '\2' || chr(2), 'g') marked from d)))
        where i > 1 and length(split_part(piece, chr(2), 1)) - 1 - length(split_part(piece, chr(3), 1)) >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') n_{r.kind}" for r in RULES if r.base)
    one = "kind || ':' || start::bigint || ':' || \"end\"::bigint"
    return f"""
    with d as (select doc_id, row_number() over () id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) plain from documents),
    s as ({" union all ".join(parts)})
    select doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' order by start, rank) filter (kind in ({base})), '')) base_sha256,
           coalesce(string_agg({one}, ',' order by start, rank) filter (kind is not null), '') spans
    from d left join s using (id) group by d.id, doc_id"""
