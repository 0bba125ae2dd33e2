import re

import edges
from keylink.llm.pii import find_personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


TEXTS = [
    "a@b.co.x_d@e.fg and x@y and .@a.b 🙂🙂 me@host.example.org", "1.2.3.4.5 256.1.1.1 001.02.3.4 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000 5" * 2, "+1 (555) 123-4567, +12 3 + 49 30 12345678901",
    "+49.30.1234567 8 . token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\" end", "9" * 5000 + "@", "x" * 3000 + "@y.z",
    "call me at (212) 555-0199 or user12 [at] mail3 [dot] com today", "your password = forgotten, order no. 212 555 0199",
    "٣٤٥ é@ü.com a@b.c\n1.1.1.1\n\n+1-202-555-0143", "", None, "+" * 400 + "1" * 12, "a." * 500 + "@b.c",
]


def test_base_spans(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for frame in (docs, own, edges.frame(spark).select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        got = find_personal(frame).collect()
        assert len(got) == len(texts)
        for r in got:
            text = texts[r["doc_id"]] or ""
            base = [(s["kind"], s["begin"], s["end"]) for s in r["spans"] if s["base"]]
            assert base == brute(text), (r["doc_id"], base, brute(text))
            for kind in BASE:
                assert r[f"n_{kind}"] == sum(b[0] == kind for b in base)
            covered = {i for s in r["spans"] for i in range(s["begin"], s["end"])}
            left = "".join(c for i, c in enumerate(text) if i not in covered)
            assert re.sub(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", "", r["redacted"]) == re.sub(
                r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", "", left
            )


def test_added_spans(spark):
    own = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_personal(own).collect()}
    added = lambda i: [TEXTS[i][s["begin"] : s["end"]] for s in got[i]["spans"] if not s["base"]]
    assert added(7) == ["(212) 555-0199", "user12 [at] mail3 [dot] com"]
    assert added(4) == ["token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\""]
    assert added(8) == []


def test_empty_table(spark):
    assert find_personal(edges.empty(spark)).collect() == []
