import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomset.llm import pii
from tests.llm.helpers import DOCS, ODD, docs


def brute(text):
    """The contract's patterns as written."""
    out = []
    for kind, pat in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pat, text or ""):
            s = m[0]
            d = re.sub("[^0-9]", "", s)
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
                "card": lambda: 14 <= len(d) <= 19 and (sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])) % 10 == 0,
                "phone": lambda: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.BASE.index(x[0])))


@settings(max_examples=600, deadline=None)
@given(st.text("a.@+-%12345 ()\n é0", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == brute(text)


def test_validators_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert [s[:3] for s in pii.find_spans("pay to DE89370400440532013000 now")] == [("iban", 7, 29)]
    assert pii.find_spans("number 555-123-4567") == []
    assert [s[0] for s in pii.find_spans("please call 555-123-4567")] == ["local_phone"]
    plain, near = pii.find_spans("10.0.0.1")[0], pii.find_spans("server address 10.0.0.1")[0]
    assert near[3] > plain[3]


def test_query_rows_and_odd_input(spark):
    text = "mail é a.b@c.example.org or +1 (456) 555-2186, card 4041 8949 7460 8795 at 1.2.3.4 and 999.1.1.1"
    rows = {r.doc_id: r for r in pii.pii_spans(docs(spark, [*ODD, (9, text)])).collect()}
    assert len(pii.pii_spans(docs(spark, ODD)).collect()) == len(ODD)
    want = brute(text)
    assert rows[9].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert (rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone) == tuple(sum(w[0] == k for w in want) for k in pii.BASE)
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.pii_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_redaction(spark):
    df = docs(spark, [*ODD, (9, "write to a@b.example or 1.2.3.4.")])
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[9] == "write to [EMAIL] or [IP]." and got[1] is None and got[2] == "" and got[5] == "x" * 300_000
    assert pii.redact(df).columns == df.columns


def test_long_runs_take_linear_time():
    assert pii.find_spans("1" * 500_000 + "." + "a" * 500_000 + "@" * 1000) == []
