from __future__ import annotations

import hashlib
import re
import time

from helpers import DOCS, SF, clashing, docs, texts
from pyspark.sql import functions as F
from weftline.llm.pii import find_personal_data, mask_documents, masked
from weftline.llm.registry import op9_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(r, text):
    want = base(text)
    listed = [":".join(map(str, s)) for s in want]
    assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (text or "")[:200]
    assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in PATTERNS]
    assert [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS] == listed


AWKWARD = [
    None, "", "a@b.c.d@e.f x@y.z_w@q.r", "é1.2.3.4.5.6.7.8 🙂 0001.002.255.256 999.1.1.1 10.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (974) 555-3436, +49 30 1234567 +1 2 +123456789012345678", "1" * 5000, "a" * 5000 + "@x.y", "1.1.1.1" * 50, "@.@ a@b a@b.-", "4111111111111111@x.yz",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "+" * 100 + "1" * 9, "a@b.c_x@y.z%+q@r.s.t-@u.v", "x@y.z.w@a.b@c.d", "12.3.4.5.67.8.9.0.1.2", ".@a.b@c.d @@e@f.g",
]


def test_awkward_texts_against_brute_force(spark):
    for r in find_personal_data(texts(spark, *AWKWARD)).collect():
        check(r, AWKWARD[r.doc_id])


def test_whole_table_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op9_pii(spark, SF).collect()
    assert len(found) == len(rows) and sum(r.n_card for r in found) and sum(r.n_email for r in found)
    for r in found:
        check(r, rows[r.doc_id])


def test_validators_and_context(spark):
    said = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "my SSN is 123-45-6789", "part 123-45-6789", "xDE89370400440532013000", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""]
    spans = [r.spans for r in find_personal_data(texts(spark, *said)).orderBy("doc_id").collect()]
    assert spans == ["iban:5:32", "", "ssn:10:21", "", "", "secret:9:49"]


def test_masks(spark):
    said = ["mail a@b.cd or call +1 (974) 555-3436!", "no data", None, "", "4111111111111111@x.yz"]
    found = [r.m for r in texts(spark, *said).orderBy("doc_id").select(masked(F.col("text")).alias("m")).collect()]
    assert found == ["mail [EMAIL] or call [PHONE]!", "no data", None, "", "[EMAIL]"]
    out = mask_documents(docs(spark))
    assert out.columns == docs(spark).columns and out.count() == 11
    assert mask_documents(clashing(spark)).columns == clashing(spark).columns


def test_no_rows_and_native_plan(spark):
    found = find_personal_data(spark.createDataFrame([], DOCS))
    assert found.count() == 0
    plan = find_personal_data(texts(spark, "a"))._jdf.queryExecution().toString() + mask_documents(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_of_any_length(spark):
    sizes = (31, 32, 64, 65, 128, 5000)
    rows = texts(spark, *[f"token={('ab12' * 1250)[:n]} end" for n in sizes])
    found = sorted(find_personal_data(rows).collect(), key=lambda r: r.doc_id)
    assert [r.spans for r in found] == ["" if n < 32 else f"secret:6:{6 + n}" for n in sizes]
    assert sum(r.text == "token=[SECRET] end" for r in mask_documents(rows).collect()) == len(sizes) - 1


def test_context_words_in_any_case(spark):
    key = "Ab3_" * 10
    said = [f"{w}{sep}{key} end" for w in ("API_KEY", "Password", "TOKEN", "Secret", "token") for sep in ("=", ": ", " ")]
    rows = texts(spark, *said, f"nothing {key} here", f"x{'y' * 60} TOKEN {key}")
    found = sorted(find_personal_data(rows).collect(), key=lambda r: r.doc_id)
    assert [r.spans for r in found[: len(said)]] == [f"secret:{t.index(key)}:{t.index(key) + 40}" for t in said]
    assert found[-2].spans == "" and "secret:68:108" in found[-1].spans
    assert all("[SECRET]" in r.text for r in mask_documents(rows).collect() if r.doc_id < len(said))


def test_long_runs_take_linear_time(spark):
    n = 1 << 20
    said = ["x" * n + "@", "Q" * n + "@b.c", "a@" + "b" * n, "1" * n + ".1", "1." * (n // 2), "+1" + " " * n, "A1b2" * (n // 4) + " api_key", "a." * (n // 2) + "@c", "é@" * (n // 2), "TOKEN " + "z" * n]
    rows = texts(spark, *said).repartition(4).cache()
    rows.count()
    began = time.time()
    found = {r.doc_id: r for r in find_personal_data(rows).collect()}
    assert time.time() - began < 60
    assert [found[k].n_email for k in range(10)] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert found[9].spans == f"secret:6:{n + 6}" and found[6].spans == f"secret:0:{n}" and found[4].n_ip == n // 8
    began = time.time()
    assert sum("[SECRET]" in r.text for r in mask_documents(rows).collect()) == 2
    assert time.time() - began < 60


def test_work_is_about_linear_in_the_matches(spark):
    def seconds(n):
        frame = texts(spark, "".join(f"{10 + i}, a{i}@x.yz é " for i in range(n))).cache()
        frame.count()
        began = time.time()
        (r,) = find_personal_data(frame).collect()
        assert r.n_email == n
        (m,) = mask_documents(frame).collect()
        assert m.text.count("[EMAIL]") == n
        return time.time() - began

    seconds(10)
    assert seconds(100_000) < 20 * seconds(10_000) + 20
