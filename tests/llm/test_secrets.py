import math
import re

from kernloom.llm import secrets as S

KEY = "AKIA" + "ABCDEFGH23456789"


def brute(text):
    """All spans from Python's re and a fresh entropy per window."""
    out = []
    for m in re.finditer(S.ASSIGN.replace("(?i:", "(?i:"), text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(S.ACCESS, text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(S.HEX, text) if len(m.group()) >= 24]
    for m in re.finditer(S.CANDIDATE, text):
        s = m.group()
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.search(a, s) for a in S.ALLOW):
            continue
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
            limit = S.LIMITS["hex"]
        else:
            limit = S.LIMITS["single" if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", s) else "mixed"]
        spans = []
        for i in range(len(s) - S.WINDOW + 1):
            w = s[i : i + S.WINDOW]
            if -sum(w.count(c) / S.WINDOW * math.log2(w.count(c) / S.WINDOW) for c in set(w)) >= limit - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + S.WINDOW
                else:
                    spans.append([i, i + S.WINDOW])
        out += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return sorted(out)


TEXTS = [
    None,
    "",
    "plain words only",
    f"é key {KEY} and token: token:abcdef and Password = 'a1b2c3d4'",
    "token=password=abcdefgh secret: abc; API-KEY=zzzzzz apikey:zzzzzzz",
    "0123456789abcdef0123456789abcdef 550e8400-e29b-41d4-a716-446655440000",
    "dead" * 30000 + " x9Kd83ksLq02mZpQ7vT1bN5 " + "😀" * 3 + "9f86d081884c7d659a2feaa0c55ad015",
    "aaaaaaaaaaaaaaaa1 " * 40,
    f"{KEY} {KEY}{KEY}",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, secret_spans string")


def test_matches_brute_force(spark):
    got = {r[0]: [tuple(x) for x in r[1]] for r in S.scan_secrets(frame(spark, TEXTS)).select("doc_id", "secret_spans").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t or ""), t and t[:60]


def test_redact_and_empty(spark):
    rows = {r.doc_id: r.text for r in S.redact(frame(spark, TEXTS + [TEXTS[3]]).drop("secret_spans")).collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == TEXTS[2]
    assert KEY not in rows[3] and "a1b2c3d4" not in rows[3] and rows[3].startswith("é key [SECRET] and ")
    assert rows[9] == rows[3]
    assert S.op9_secret_scan(frame(spark, [])).count() == 0
