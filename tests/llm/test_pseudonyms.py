import datetime
import hashlib
import math
import re

from opsloom.llm.pseudonyms import KEY, ROUNDS, pseudonymise


def permuted(value, left, right, count, kind):
    while True:
        a, b = divmod(value, right)
        for r in range(1, ROUNDS + 1):
            half, modulus = (b, left) if r % 2 else (a, right)
            name = f"{KEY}|{kind}|{count}|{r}|{half}"
            add = int(hashlib.sha256(name.encode()).hexdigest()[:15], 16) % modulus
            a, b = ((a + add) % left, b) if r % 2 else (a, (b + add) % right)
        value = a * right + b
        if value < count:
            return value


def below(value, count, kind):
    left = math.isqrt(count - 1) + 1
    return permuted(value, left, -(-count // left), count, kind)


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])


def card(text):
    digits = re.sub(r"\D", "", text)
    if luhn(digits) % 10:
        return text
    size = len(digits) - 1
    left, right = 10 ** ((size + 1) // 2), 10 ** (size // 2)
    new = str(permuted(int(digits[:-1]), left, right, left * right, "card")).zfill(size)
    new += str(-luhn(new + "0") % 10)
    out = iter(new)
    return re.sub(r"\d", lambda m: next(out), text)


def day(text, form):
    first = datetime.date(1900, 1, 1)
    value = (datetime.datetime.strptime(text, form).date() - first).days
    return (first + datetime.timedelta(days=below(value, 73049, "date"))).strftime(form)


def ip(text):
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return text
    new = below(sum(p << s for p, s in zip(parts, (24, 16, 8, 0))), 2 ** 32, "ip")
    return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))


def out(spark, *texts):
    rows = pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    return [r for r in rows.orderBy("doc_id").collect()]


def test_each_kind_as_plain_python(spark):
    got = out(spark, "pay 4111111111111111 or 4111-1111-1111-1111 now", "no 4111111111111112 here",
              "on 2024-02-29, 31.12.1999 and 12/31/2020", "not 2023-02-30 nor 99.12.1999", "at 10.0.0.1 not 10.0.0.300",
              "378282246310005")
    assert got[0].text == f"pay {card('4111111111111111')} or {card('4111-1111-1111-1111')} now"
    assert re.sub(r"\D", "", got[0].text)[:16] == re.sub(r"\D", "", got[0].text)[16:]
    assert got[1].text == "no 4111111111111112 here" and got[1].n_replaced == 0
    assert got[2].text == (f"on {day('2024-02-29', '%Y-%m-%d')}, {day('31.12.1999', '%d.%m.%Y')} and "
                           f"{day('12/31/2020', '%m/%d/%Y')}")
    assert got[3].text == "not 2023-02-30 nor 99.12.1999"
    assert got[4].text == f"at {ip('10.0.0.1')} not 10.0.0.300"
    assert got[5].text == card("378282246310005") and luhn(got[5].text) % 10 == 0


def test_numbers_keep_format_and_stay_distinct(spark):
    texts = [f"+1 (212) 555-{i:04d} and 123-45-{6000 + i}" for i in range(300)]
    rows = out(spark, *texts)
    assert all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d{2}-\d{4}", r.text) for r in rows)
    assert len({r.text.split(" and ")[0] for r in rows}) == 300 == len({r.text.split(" and ")[1] for r in rows})
    assert all(r.n_phone == 1 and r.n_ssn == 1 and r.n_replaced == 2 for r in rows)
    same = out(spark, *["call (212) 555-0001"] * 3)
    assert len({r.text for r in same}) == 1 and same[0].text != "call (212) 555-0001"


def test_a_permutation_of_all_small_values():
    assert sorted(below(i, 500, "t") for i in range(500)) == list(range(500))


def test_edges_and_tables(edges, empty, tables, spark):
    rows = {(r.doc_id, r.text) for r in pseudonymise(edges).collect()}
    assert rows == {(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()}
    assert pseudonymise(empty).collect() == []
    docs = tables("documents").toPandas().set_index("doc_id").text
    changed = 0
    for r in pseudonymise(tables("documents")).collect():
        old = docs[r.doc_id]
        runs = re.findall(r"(?<![0-9A-Za-z_.-])[0-9]{13,19}(?![0-9A-Za-z_]|[.-][0-9])", old)
        for m in runs:
            assert (card(m) in r.text) and (luhn(m) % 10 or m not in r.text)
            changed += luhn(m) % 10 == 0
        if r.n_replaced == 0:
            assert r.text == old
    assert changed


def test_mail_addresses_link(spark):
    a, b, c = out(spark, "to ann.b@x.example.com.", "from Ann.B@X.example.com", "é.q@x.example.com")
    assert re.fullmatch(r"to user[0-9a-f]{12}@x\.example\.com\.", a.text)
    assert a.text[3:19] == b.text[5:21] and c.n_mail == 1
