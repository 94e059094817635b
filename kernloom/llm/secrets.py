"""Secret scans: fixed patterns plus sliding-window Shannon entropy, in SQL functions only.

Base kinds, leftmost non-overlapping within a kind: ``assign`` (a named value of 6 or more
characters), ``access`` (an access key of 20 or more) and ``hex`` (24 or more digits).
The entropy kind looks at candidate strings: whole runs of ``[A-Za-z0-9+/_-]`` of at least
one window that hold a letter and a digit. Each has one character class (hex, one letter
case with digits, mixed) with its own limit in bits. A window slides over the candidate; its
character counts change by one in and one out per step, and the sum of c*log2(c) with them.
Windows that reach the limit are merged into spans. Candidates on the allow-list (UUIDs,
counting sequences, placeholders) give none; base matches always stay.

Positions are code points, end exclusive. They come from splitting the text by the pattern:
the pieces' and the matches' lengths, summed from the left.

Nulls and empty texts have no spans; repeated rows give repeated results; an empty table
gives an empty result; other columns are kept untouched (the added one replaces a column of
its name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: The entropy kind: candidate runs, window, limits in bits by class (no window of this size
#: has an entropy within 1e-6 of them).
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
WINDOW = 16
LIMITS = {"hex": 2.55, "single": 2.95, "mixed": 3.15}
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"

#: Candidates that are no secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefgh|01234567|example|xxxxxx|placeholder",
)

SPAN = "struct<start:bigint,kind:int,end:bigint>"


def _placed(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """array<SPAN> of the pattern's matches whose ``group`` has ``least`` characters or more."""
    pattern_col = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.transform(F.regexp_extract_all(text, pattern_col, F.lit(0)), F.char_length)
    if group:
        judged = F.transform(F.regexp_extract_all(text, pattern_col, F.lit(group)), F.char_length)
        hits = F.zip_with(hits, judged, lambda whole, part: F.struct(whole.alias("n"), part.alias("j")))
    else:
        hits = F.transform(hits, lambda n: F.struct(n.alias("n"), n.alias("j")))
    steps = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h["n"].alias("n"), h["j"].alias("j")))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["p"]
        end = start + F.coalesce(x["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        out = F.when(F.coalesce(x["j"], F.lit(-1)) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """array<SPAN> of the three base kinds. A cheap test first: most texts hold none."""
    none = F.array().cast(f"array<{SPAN}>")
    assign = F.when(text.rlike(ASSIGN), _placed(text, ASSIGN, 0, ASSIGN_LEAST, group=2)).otherwise(none)
    access = F.when(text.contains("AKIA"), _placed(text, ACCESS, 1, ACCESS_LEAST)).otherwise(none)
    # a run of hex digits is taken whole, so the least length can be asked for in the pattern
    whole_hex = HEX.replace("+", f"{{{HEX_LEAST},}}")
    hexes = F.when(text.rlike(whole_hex), _placed(text, whole_hex, 2, HEX_LEAST)).otherwise(none)
    return F.concat(assign, access, hexes)


def _windows(chars: Column, limit: Column) -> Column:
    """array<struct<start,end>> within one candidate: windows at or over ``limit``, merged."""
    n = F.size(chars)
    weight = F.expr("transform(sequence(0, %d), c -> if(c < 2, 0D, c * log2(c)))" % WINDOW)
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    spans = "array<struct<start:int,end:int>>"
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.array().cast(spans).alias("out"),
    )

    def fold(codes: Column, weight: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.when(i >= WINDOW, F.get(codes, F.greatest(i - WINDOW, F.lit(0)))).otherwise(F.lit(-1))
            counts = state["counts"]
            same = new == old
            gain = F.get(weight, F.get(counts, new) + 1) - F.get(weight, F.get(counts, new))
            had = F.get(counts, F.greatest(old, F.lit(0)))
            loss = F.when(old >= 0, F.get(weight, had) - F.get(weight, F.greatest(had - 1, F.lit(0)))).otherwise(F.lit(0.0))
            total = state["sum"] + F.when(same, F.lit(0.0)).otherwise(gain - loss)
            changed = F.when(same, counts).otherwise(
                F.transform(counts, lambda c, j: c + (j == new).cast("int") - (j == old).cast("int"))
            )
            bits = F.lit(float(WINDOW)).cast("double")
            entropy = F.log2(bits) - total / bits
            first = i - (WINDOW - 1)
            last = F.element_at(state["out"], -1)
            grown = F.concat(
                F.slice(state["out"], 1, F.size(state["out"]) - 1),
                F.array(F.struct(last["start"].alias("start"), (i + 1).alias("end"))),
            )
            added = F.concat(state["out"], F.array(F.struct(first.alias("start"), (i + 1).alias("end"))))
            out = (
                F.when((first < 0) | (entropy < limit - 1e-9), state["out"])
                .when((F.size(state["out"]) > 0) & (last["end"] >= first), grown)
                .otherwise(added)
            )
            return F.struct(changed.alias("counts"), total.alias("sum"), out.alias("out"))

        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])

    # each value is bound once as the element of a one-element array
    return F.flatten(F.transform(F.array(F.struct(codes.alias("c"), weight.alias("w"))), lambda x: fold(x["c"], x["w"])))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """array<SPAN> of the entropy kind."""
    found = _placed(text, CANDIDATE, 3, WINDOW)
    strings = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.zip_with(found, strings, lambda span, s: F.struct(span.alias("span"), s.alias("s")))

    def wanted(x: Column) -> Column:
        keep = x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]")
        for pattern in allow:
            keep = keep & ~x["s"].rlike(pattern)
        return keep

    def of(x: Column) -> Column:
        s = x["s"]
        limit = (
            F.when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), F.lit(LIMITS["hex"]))
            .when(s.rlike("^[0-9a-z]+$") | s.rlike("^[0-9A-Z]+$"), F.lit(LIMITS["single"]))
            .otherwise(F.lit(LIMITS["mixed"]))
        )
        inner = F.flatten(
            F.transform(F.array(F.split(s, "").alias("c")), lambda c: _windows(F.filter(c, lambda y: y != ""), limit))
        )
        return F.transform(
            inner,
            lambda w: F.struct(
                (x["span"]["start"] + w["start"]).alias("start"),
                F.lit(3).alias("kind"),
                (x["span"]["start"] + w["end"]).alias("end"),
            ),
        )

    spans = F.flatten(F.transform(F.filter(both, wanted), of))
    none = F.array().cast(f"array<{SPAN}>")
    likely = text.rlike(r"[0-9][A-Za-z0-9+/_-]{7}|[A-Za-z0-9+/_-]{7}[0-9]") & text.rlike(CANDIDATE)
    return F.when(likely, spans).otherwise(none)


def scan_secrets(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``secret_spans``: array<struct<start, kind, end>> sorted by start, kind (an
    index into KINDS), end."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("secret_spans", F.array_sort(F.concat(base_spans(text), entropy_spans(text, allow))))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with each found span of ``text_col`` replaced by ``mark``; overlapping spans count
    as one. Texts without spans, null ones among them, stay as they are."""
    scanned = scan_secrets(docs, text_col, allow)
    text = F.col(text_col)

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(
        F.col("secret_spans"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        step,
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return scanned.withColumn(text_col, F.when(F.size("secret_spans") > 0, done).otherwise(text)).drop("secret_spans")


def op9_secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document in the contract's form."""
    rows = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("bigint")

    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("secret_spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def _sql_placed(pattern: str, kind: int, least: int, group: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rid, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: {{
      'start': list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[:i-1], lambda x: length(x))), 0)::BIGINT,
      'kind': {kind},
      'end': list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(h[:i], lambda x: length(x)))::BIGINT,
      'ok': length(j[i]) >= {least}, 's': h[i]}}), lambda x: x.ok)) AS x
  FROM (SELECT rid, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS h,
               regexp_extract_all(t, '{quoted}', {group}) AS j FROM d)"""


def oracle_op9() -> str:
    """The same in DuckDB SQL; there each window's entropy is computed afresh."""
    allow = " AND ".join(f"NOT regexp_matches(x.s, '{a}')" for a in ALLOW)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_sql_placed(ASSIGN, 0, ASSIGN_LEAST, 2)}
  UNION ALL {_sql_placed(ACCESS, 1, ACCESS_LEAST)}
  UNION ALL {_sql_placed(HEX, 2, HEX_LEAST)}),
cand AS (SELECT rid, x.start AS s0, x.s AS s FROM ({_sql_placed(CANDIDATE, 3, WINDOW)}) q
         WHERE regexp_matches(x.s, '[0-9]') AND regexp_matches(x.s, '[A-Za-z]') AND {allow}),
win AS (SELECT rid, s0, s, unnest(range(0, length(s) - {WINDOW} + 1)) AS w,
          CASE WHEN regexp_full_match(s, '[0-9a-f]+') OR regexp_full_match(s, '[0-9A-F]+') THEN {LIMITS['hex']}
               WHEN regexp_full_match(s, '[0-9a-z]+') OR regexp_full_match(s, '[0-9A-Z]+') THEN {LIMITS['single']}
               ELSE {LIMITS['mixed']} END AS lim FROM cand),
good AS (SELECT rid, s0, w, lag(w) OVER (PARTITION BY rid, s0 ORDER BY w) AS pw FROM win
         WHERE list_entropy(string_split(substr(s, (w + 1)::BIGINT, {WINDOW}), '')) >= lim - 1e-9),
grp AS (SELECT *, sum(CASE WHEN pw IS NOT NULL AND w <= pw + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, s0 ORDER BY w) AS g FROM good),
spans AS (SELECT rid, x.start AS st, x.kind AS kind, x."end" AS en FROM base
          UNION ALL SELECT rid, s0 + min(w), 3, s0 + max(w) + {WINDOW} FROM grp GROUP BY rid, s0, g),
named AS (SELECT rid, st, kind, en, ['assign','access','hex','entropy'][kind + 1] || ':' || st || ':' || en AS nm FROM spans),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
   coalesce(string_agg(nm, ',' ORDER BY st, kind, en) FILTER (kind < 3), '') AS b, string_agg(nm, ',' ORDER BY st, kind, en) AS a FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
   sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN agg USING (rid)"""
