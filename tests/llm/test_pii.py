import hashlib
import re

import pytest

from driftmatch.llm.pii import ANY, PATTERNS, pseudonymise

KEY = "k"


def run(spark, texts, key=KEY, count_col="n_replaced"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_chars string")
    return pseudonymise(df, key, count_col=count_col)


def out(spark, *texts):
    return [r.text for r in run(spark, texts).orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def prf(tweak, i, value):
    return int(hashlib.sha256("|".join([KEY, tweak, str(i), str(value), KEY]).encode()).hexdigest()[:15], 16)


def feistel(x, y, mx, my, tweak):
    for i in range(10):
        if i % 2 == 0:
            x = (x + prf(tweak, i, y) % mx) % mx
        else:
            y = (y + prf(tweak, i, x) % my) % my
    return x, y


def test_formats_stay_and_values_link(spark):
    a, b, c = out(spark, "mail Bob.Smith2@mail3.example.com, card 4111111111111111!", "bob.smith2@MAIL3.example.com 4111-1111-1111-1111", "4111 1111 1111 1111")
    mail, card = re.match(r"mail (\S+), card (\d{16})!", a).groups()
    assert b == f"{mail} {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}" and c == " ".join(card[k : k + 4] for k in range(0, 16, 4))
    assert luhn(card) and card != "4111111111111111" and mail.endswith(".com") and "bob" not in mail


def test_dates_link_across_formats(spark):
    (t,) = out(spark, "2020-02-29, 29.02.2020, 2/29/2020, 29/02/2020, February 29, 2020; 29 Feb 2020")
    y, m, d = map(int, t[:10].split("-"))
    assert (y, m, d) != (2020, 2, 29)
    assert f"{d:02d}.{m:02d}.{y}" in t and f"{d:02d}/{m:02d}/{y}" in t and t.count(str(y)) == 6


def test_each_kind_stays_valid(spark):
    (t,) = out(spark, "+1 (743) 555-3824|743-555-3824|10.20.30.40|123-45-6789|GB82 WEST 1234 5698 7654 32|DE89370400440532013000|+49 30 1234567")
    p1, p2, ip, ssn, gb, de, intl = t.split("|")
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", p1) and re.sub(r"\D", "", p1)[1:] == re.sub(r"\D", "", p2)
    assert re.fullmatch(PATTERNS["ip"], ip) and ip != "10.20.30.40"
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", ssn) and ssn != "123-45-6789"
    assert mod97(gb) and mod97(de) and gb.startswith("GB") and gb[5:9] == "WEST" and de != "DE89370400440532013000"
    assert intl.startswith("+49 3")


def test_invalid_values_stay(spark):
    for t in ("4111111111111112", "666-12-1234", "000-12-1234", "30 February 2020", "2021-02-29", "DE89370400440532013001", "version 1.2.3.4.5", "300.1.1.1", "2500-01-01", "no data here", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"):
        assert out(spark, t) == [t]


def test_permutation_of_dates_and_digits(spark):
    """Different values get different pseudonyms, and the ones of a brute-force network."""
    days = [f"2{i // 372:03d}-{i // 31 % 12 + 1:02d}-{i % 31 + 1:02d}" for i in range(744)]
    import datetime

    def ok(s):
        try:
            return datetime.date.fromisoformat(s)
        except ValueError:
            return None

    valid = [s for s in days if ok(s)]
    got = out(spark, *valid)
    assert len(set(got)) == len(valid)
    origin = datetime.date(1800, 1, 1)
    for s, g in zip(valid[:50], got):
        x, y = divmod((ok(s) - origin).days, 773)
        x, y = feistel(x, y, 189, 773, "date")
        assert datetime.date.fromisoformat(g) == origin + datetime.timedelta(days=x * 773 + y)
    cards = [p + str(next(k for k in range(10) if luhn(p + str(k)))) for p in (f"{n:015d}" for n in range(4 * 10**14, 4 * 10**14 + 300))]
    got = out(spark, *cards)
    assert len(set(got)) == 300 and all(map(luhn, got))
    for c, g in zip(cards[:20], got):
        x, y = feistel(int(c[:7]), int(c[7:15]), 10**7, 10**8, "card:15")
        assert g[:15] == f"{x:07d}{y:08d}"


def test_key_matters(spark):
    a, b = (run(spark, ["4111111111111111"], k).first().text for k in ("a", "b"))
    assert a != b
    with pytest.raises(ValueError):
        run(spark, [""], "")


def test_edges(spark):
    r = run(spark, [None, "", "4111111111111111", "4111111111111111", "x " * 200_000 + "a@b.org"]).orderBy("doc_id").collect()
    assert r[0].text is None and r[0].n_replaced == 0 and r[1].text == "" and r[2].text == r[3].text
    assert r[4].n_replaced == 1 and len(r[4].text) == 400_007 and r[4].n_chars == "x"
    assert run(spark, []).count() == 0
    (t,) = out(spark, "4111111111111111 4111111111111111\n4111111111111111")
    assert len(set(t.split())) == 1


def test_no_python_in_the_plan(spark):
    plan = run(spark, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert re.compile(ANY)


def test_secrets(spark):
    hexes = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'x token = "{hexes}" y', f"API_KEY: {hexes}", f"password='{hexes[:-1]}0'", "secret=AbCdEfGh12345678-xyz", "token = short", f"tokens {hexes}", hexes]
    got = out(spark, *texts)
    assert got[4:] == texts[4:]
    a, b, c = (re.search("[0-9a-f]{40}", x)[0] for x in got[:3])
    assert a == b != hexes and c not in (a, hexes) and got[0] == texts[0].replace(hexes, a) and got[1].startswith("API_KEY: ")
    assert re.fullmatch("secret=[A-Z][a-z][A-Z][a-z][A-Z][a-z][A-Z][a-z][0-9]{8}-[a-z]{3}", got[3]) and got[3] != texts[3]


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([(1, "write to joe@example.com", "keep", "p", "n")], "doc_id int, text string, n_replaced string, __pii string, __new string")
    got = pseudonymise(df, KEY)
    row = got.first()
    assert got.columns == [*df.columns, "n_replaced_"] and (row.n_replaced, row.n_replaced_, row["__pii"], row["__new"]) == ("keep", 1, "p", "n")
