"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is validated for its kind (check digit, ranges, calendar) and only
valid ones are replaced. Numbers and dates go through a keyed Feistel network over exactly their own
domain, so the pseudonym is again valid, keeps separators and (addresses aside) length, and the map is one-to-one:
equal values get equal pseudonyms in every document and different ones stay different.

* card: 13 to 19 digits with a right Luhn digit, unbroken or in a card's groups behind the number of an issuer; the payload is permuted, the Luhn digit worked out anew.
* iban: mod-97 valid; country, length and letters stay, digits are permuted, check digits follow.
* ssn: area, group and serial within their ranges, permuted over exactly those values.
* phone: the digits after the country code, which the table of codes tells without separators; numbers without a code are of code 1, so all spellings of a number stay linked.
* ip: four octets up to 255, permuted as a 32-bit number and written without leading zeros, so its length may change.
* date: a real day, not one in a path or query of a URL, as yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy, permuted within its 400-year cycle.
* email and secret have no numeric domain: a keyed digest in the same alphabet takes their place.

Cards and IBANs are looked for in whole runs of tokens, so what stands beside one (an expiry date, a code, a currency) doesn't hide it:
where a run isn't valid as a whole, each of its tokens is tried as a beginning: of an IBAN of its country's length, of a card in groups of 4-4-4-4, 4-6-5 or 4-6-4 or unbroken, in either case with an issuer's
number and length, or of a secret. The leftmost valid part is taken and the next one sought behind it. Numbers in a row aren't cards by their Luhn digit alone, which one in ten has by chance: four groups of four digits with five more of
them before or behind belong to a table and stay, unless those behind are cards themselves, and so do years, counts and timestamps. The work is linear in the run.

Text that only looks like one of these (a number with a wrong check digit, an octet over 255) stays.
Defined cases: null text stays null with no findings; empty text stays empty; equal rows give
equal rows; all other columns pass through :func:`pseudonymised` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

#: Where the session has the key, and the key of tests and demonstrations for sessions without one.
KEY_SETTING, KEY = "spark.postlens.pii.key", "postlens-demo-key"
ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card", "secret")

EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
DATE = r"(?<![/=])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?!/)"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}([.\-])[0-9]{3}\2[0-9]{4}"
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}"
#: No more of the run where another kind begins.
_OTHER = r"(?!(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![A-Za-z0-9]|[.\-][0-9]))"
_END = r"(?![A-Za-z0-9]|\.[0-9])"
#: Runs of whole tokens in which a card or an IBAN may stand; possessive, as Java would else recurse for each token.
CARD_RUN = rf"(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9]++{_END}(?:(?: {_OTHER}|-)[0-9]++{_END})*+"
IBAN_RUN = rf"(?=[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2}})[A-Z0-9]++{_END}(?!-[0-9])(?: [A-Z0-9]++{_END}(?!-[0-9]))*+"
SECRET = r"[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,48}"
PATTERN = rf"(?<![A-Za-z0-9._%+\-])(?:{EMAIL})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?<![0-9][.\-])(?:{IBAN_RUN}|{DATE}|{IP}|{SSN}|{PHONE}|{CARD_RUN}|{SECRET})(?![A-Za-z0-9])(?![.\-][0-9])"
#: A text without these characters holds none of the kinds.
GATE = r"[0-9@]"

#: Length by country of the IBAN registry.
_IBAN_SIZES = {size: names.split() for size, names in {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()}
#: Country codes of two digits (fixed values of the numbering plan); 1 and 7 have one digit and all others three.
_TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Numbers of issuers with their lengths (fixed values of the public ranges).
ISSUER = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|5[0678][0-9]{11,17}|6[0-9]{12,18})$"
#: How a card that stands alone may be grouped, and how one among other tokens.
GROUPED = r"[0-9]{4}([ \-])[0-9]{3,6}(?:\1[0-9]{3,6}){1,2}(?:\1[0-9]{1,6})?"
_AMONG = r"[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}"
_IBAN_SIZED = "|".join(rf"(?:{'|'.join(names)})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, names in _IBAN_SIZES.items())
#: A part at the beginning of some tokens; so many tokens hold the longest one and what a table is told by.
_PART, _PART_TOKENS = rf"^(?:{_IBAN_SIZED}|{_AMONG}|{SECRET})(?![A-Za-z0-9])", 12

_CYCLE_DAYS, _CYCLE_A, _CYCLE_B = 146097, 189, 773  # days in 400 years, and two factors of that


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _round(key: str, domain: Column, i: Column, value: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), domain, i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, domain: Column, key: str, rounds: int = ROUNDS) -> Column:
    """struct(a, b): a keyed permutation of the pairs (a, b) with a < mod_a and b < mod_b."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = _round(key, domain, i, F.when(even, acc["b"]).otherwise(acc["a"]))
        return F.struct(
            F.when(even, (acc["a"] + f % mod_a) % mod_a).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + f % mod_b) % mod_b).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permuted_digits(d: Column, domain: str | Column, key: str) -> Column:
    """A string of 2 to 36 digits as another one of the same length."""

    def body(x: Column) -> Column:
        n = F.length(x)
        u, v = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        halves = feistel(F.left(x, u).cast("long"), F.right(x, v).cast("long"), ten(u), ten(v), F.concat(domain if isinstance(domain, Column) else F.lit(domain), n.cast("string")), key)
        return let(halves, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), v, "0")))

    return let(d, body)


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    chars = F.split(shape, "")
    place = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda ch, i: F.when(ch.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(ch)), "")


def _luhn_sum(d: Column) -> Column:
    """Luhn's sum of all digits but a missing last one."""
    each = F.split(F.reverse(d), "")
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(each, lambda x, i: F.when(i % 2 == 0, double(x.cast("int"))).otherwise(x.cast("int"))), F.lit(0), lambda acc, x: acc + x)


def _card_ok(s: Column) -> Column:
    d = _digits(s)
    payload, last = F.left(d, F.length(d) - 1), F.right(d, F.lit(1)).cast("int")
    return (F.length(d).between(13, 19)) & ((10 - _luhn_sum(payload) % 10) % 10 == last)


def _card(s: Column, key: str) -> Column:
    payload = permuted_digits(F.left(_digits(s), F.length(_digits(s)) - 1), "card", key)
    return let(payload, lambda p: _refilled(s, F.concat(p, ((10 - _luhn_sum(p) % 10) % 10).cast("string"))))


def _mod97(s: Column) -> Column:
    """Of a string of digits and capitals, letters counting 10 to 35."""
    code = lambda ch: F.ascii(ch)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, ch: F.when(ch.rlike("[0-9]"), (acc * 10 + code(ch) - 48) % 97).otherwise((acc * 100 + code(ch) - 55) % 97))


def _iban_ok(s: Column) -> Column:
    x = F.replace(s, F.lit(" "), F.lit(""))
    return F.length(x).between(15, 34) & (_mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.left(x, F.lit(4)))) == 1)


def _iban(s: Column, key: str) -> Column:
    def body(x: Column) -> Column:
        country, rest = F.left(x, F.lit(2)), F.substring(x, F.lit(5), F.length(x))
        digits = _digits(rest)
        new = F.when(F.length(digits) >= 2, _refilled(rest, permuted_digits(digits, "iban", key))).otherwise(rest)
        return let(new, lambda r: F.concat(F.lpad((98 - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))

    # country, then check digits and account in the spaces of the original
    solid = let(F.replace(s, F.lit(" "), F.lit("")), lambda x: F.concat(F.left(x, F.lit(2)), body(x)))
    place = lambda i: F.length(F.replace(F.substring(s, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    return let(solid, lambda t: F.array_join(F.transform(F.split(s, ""), lambda ch, i: F.when(ch == " ", ch).otherwise(F.substring(t, place(i), F.lit(1)))), ""))


def _ssn_parts(s: Column) -> tuple[Column, Column, Column]:
    return F.substring(s, 1, 3).cast("int"), F.substring(s, 5, 2).cast("int"), F.substring(s, 8, 4).cast("int")


def _ssn_ok(s: Column) -> Column:
    area, group, serial = _ssn_parts(s)
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(s)
    index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    pair = feistel(index, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def text(p: Column) -> Column:
        a = F.floor(p["a"] / 99)
        return F.concat_ws("-", F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return let(pair, text)


def _ip_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda x: x.cast("int") <= 255)


def _ip(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    pair = let(o, lambda x: feistel(F.get(x, 0) * 256 + F.get(x, 1), F.get(x, 2) * 256 + F.get(x, 3), F.lit(65536), F.lit(65536), F.lit("ip"), key))
    return let(pair, lambda p: F.concat_ws(".", *[F.floor(p[h] / 256).cast("string") if hi else (p[h] % 256).cast("string") for h in "ab" for hi in (True, False)]))


def _date_parts(s: Column) -> tuple[Column, Column]:
    """The day and the format that reads it; null where there is no such day. dd/mm goes before mm/dd."""
    forms = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
    shape = {"yyyy-MM-dd": r"^[0-9]{4}-", "dd.MM.yyyy": r"^..\.", "dd/MM/yyyy": "^../", "MM/dd/yyyy": "^../"}
    read = lambda f: F.when(s.rlike(shape[f]), F.try_to_timestamp(s, F.lit(f)).cast("date"))
    form = F.coalesce(*[F.when(read(f).isNotNull(), F.lit(f)) for f in forms])
    return F.coalesce(*[read(f) for f in forms]), form


def _date(s: Column, key: str) -> Column:
    day, form = _date_parts(s)
    since = F.datediff(day, F.to_date(F.lit("1600-03-01")))
    cycle, within = F.floor(since / _CYCLE_DAYS), F.pmod(since, F.lit(_CYCLE_DAYS))
    pair = feistel(F.floor(within / _CYCLE_B), within % _CYCLE_B, F.lit(_CYCLE_A), F.lit(_CYCLE_B), F.concat(F.lit("date"), cycle.cast("string")), key)
    moved = let(pair, lambda p: F.date_add(F.to_date(F.lit("1600-03-01")), (cycle * _CYCLE_DAYS + p["a"] * _CYCLE_B + p["b"]).cast("int")))
    writes = lambda d: F.when(form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).when(form == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return let(moved, writes)


def _country_code(d: Column) -> Column:
    """The country code that the digits of an international number begin with: no code is the beginning of another, so it is found without separators."""
    two = F.left(d, F.lit(2))
    size = F.when(d.rlike("^[17]"), 1).when(two.isin(*_TWO_DIGIT_CODES), 2).otherwise(3)
    return F.left(d, size)


def _phone(s: Column, key: str) -> Column:
    """The country code stays and the digits after it are permuted, however they are grouped; a number without a code is one of code 1."""

    def body(d: Column) -> Column:
        code = F.when(F.startswith(s, F.lit("+")), _country_code(d)).otherwise(F.lit(""))
        rest = F.substring(d, F.length(code) + 1, F.length(d))
        domain = F.concat(F.lit("phone"), F.when(code == "", F.lit("1")).otherwise(code), F.lit("/"))
        return _refilled(s, F.concat(code, permuted_digits(rest, domain, key)))

    return let(_digits(s), body)


def _digest(s: Column, label: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), s), 256)


def _email(s: Column, key: str) -> Column:
    """Local part and name of the host by digest, the rest of the host kept; case does not count."""
    low = F.lower(s)
    local, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.concat(F.lit("u"), F.substring(_digest(local, "local", key), 1, 10), F.lit("@h"), F.substring(_digest(host, "host", key), 1, 8), F.lit(".invalid"))


def _secret(s: Column, key: str) -> Column:
    """Digest in hex, cut to the same length; case and a known prefix stay."""
    prefix = F.regexp_extract(s, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    body = F.concat(_digest(s, "secret", key), _digest(s, "secret2", key))
    new = F.concat(prefix, F.substring(body, F.lit(1), F.length(s) - F.length(prefix)))
    return F.when(s.rlike("^[0-9A-Z]+$"), F.upper(new)).otherwise(new)


def kind_of(s: Column) -> Column:
    """Kind of a candidate if it is valid, else null."""
    full = lambda p: s.rlike(rf"^(?:{p})$")
    return (
        F.when(F.contains(s, F.lit("@")), F.lit("email"))
        .when(full(IBAN) & _iban_ok(s), F.lit("iban"))
        .when(full(DATE) & _date_parts(s)[0].isNotNull(), F.lit("date"))
        .when(full(IP), F.when(_ip_ok(s), F.lit("ip")))
        .when(full(SSN), F.when(_ssn_ok(s), F.lit("ssn")))
        .when(full(CARD) & _card_ok(s) & (full("[0-9]+") | (full(GROUPED) & _digits(s).rlike(ISSUER))), F.lit("card"))
        .when(full(PHONE.replace(r"\2", r"\1")) & (s.rlike(r"[^0-9]")), F.lit("phone"))
        .when(full(SECRET) & ~full(r"[0-9]+"), F.lit("secret"))
    )


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret}


def pseudonym(s: Column, kind: Column, key: str = KEY, kinds: tuple[str, ...] = KINDS) -> Column:
    out = s
    for name in kinds:
        out = F.when(kind == name, _MAKERS[name](s, key)).otherwise(out)
    return out


def _sized(s: Column) -> Column:
    """Whether an IBAN has the length of its country."""
    x = F.replace(s, F.lit(" "), F.lit(""))
    out = F.lit(False)
    for size, names in _IBAN_SIZES.items():
        out = out | ((F.length(x) == size) & F.left(x, F.lit(2)).isin(names))
    return out


def _issued(s: Column) -> Column:
    return s.rlike(r"^[0-9 \-]+$") & _digits(s).rlike(ISSUER) & _card_ok(s)


def _part_kind(s: Column) -> Column:
    """Kind of a part of a run if it is valid, else null."""
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}") & _sized(s) & _iban_ok(s), F.lit("iban")).when(_issued(s), F.lit("card")).when(s.rlike(rf"^(?:{SECRET})$") & s.rlike("[^0-9]"), F.lit("secret"))


def _parts_of_run(h: Column, key: str) -> Column:
    """array of struct(k, r): a run in pieces, with pseudonyms in place of its valid parts."""

    def body(tokens: Column) -> Column:
        n = F.size(tokens)
        some = lambda i, m: F.array_join(F.slice(tokens, i, m), "")
        tried = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.regexp_extract(some(i, F.lit(_PART_TOKENS)), _PART, 0).alias("s"))), lambda p: p["s"] != "")
        fours = lambda i, m: some(i, F.lit(m)).rlike(rf"^(?:[0-9]{{4}}[ \-]){{{m - 1}}}[0-9]{{4}}(?![A-Z0-9])")
        card = lambda i: let(F.regexp_replace(some(i, F.lit(4)), r"[ \-]$", ""), _issued)
        # five groups of four before or behind one of four groups, unless those behind are cards
        table = lambda p: F.when(~p["s"].rlike(r"^[0-9]{4}[ \-][0-9]{4}[ \-]"), 0).when(fours(p["i"] + 4, 5) & ~(card(p["i"] + 4) & (~fours(p["i"] + 4, 8) | card(p["i"] + 8))), 2).when((p["i"] > 5) & fours(F.greatest(p["i"] - 5, F.lit(1)), 5), 1).otherwise(0)
        size = lambda s: F.size(F.split(s, r"[ \-]"))
        kinds = F.transform(tried, lambda p: F.struct(p["i"].alias("i"), (p["i"] + size(p["s"])).alias("z"), p["s"].alias("s"), _part_kind(p["s"]).alias("k")))
        valid = F.filter(F.transform(F.filter(kinds, lambda p: p["k"].isNotNull()), lambda p: F.struct(p["i"].alias("i"), p["z"].alias("z"), p["s"].alias("s"), p["k"].alias("k"), table(p).alias("t"))), lambda p: p["t"] < 2)
        none = F.filter(valid, lambda _: F.lit(False))
        # groups before that belong to the part taken last don't count
        step = lambda acc, v: let(F.coalesce(F.try_element_at(acc, F.lit(-1))["z"], F.lit(-9)), lambda z: F.when((z > v["i"]) | ((v["t"] == 1) & (v["i"] - z > 4)), acc).otherwise(F.concat(acc, F.array(v))))
        kept = F.aggregate(valid, none, step)

        def rebuilt(k: Column) -> Column:
            plain = lambda a, z: F.struct(F.lit(None).cast("string").alias("k"), some(a, F.greatest(z - a, F.lit(0))).alias("r"))
            before = lambda j: F.coalesce(F.get(k, j - 1)["z"], F.lit(1))
            tail = lambda v: F.regexp_extract(F.element_at(tokens, v["z"] - 1), r"[ \-]?$", 0)
            pieces = F.transform(k, lambda v, j: F.array(plain(before(j), v["i"]), F.struct(v["k"].alias("k"), F.concat(F.coalesce(pseudonym(v["s"], v["k"], key, ("iban", "card", "secret")), v["s"]), tail(v)).alias("r"))))
            return F.concat(F.flatten(pieces), F.array(plain(F.coalesce(F.try_element_at(k, F.lit(-1))["z"], F.lit(1)), n + 1)))

        return F.when(F.size(valid) == 0, F.array(F.struct(F.lit(None).cast("string").alias("k"), h.alias("r")))).otherwise(let(kept, rebuilt))

    return let(F.regexp_extract_all(h, F.lit(r"[A-Z0-9]+[ \-]?"), F.lit(0)), body)


def treated(text: Column, key: str = KEY) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kind of each replaced place in order."""

    def hit(h: Column, k: Column) -> Column:
        """array of struct(k, r): a candidate as one piece, or in pieces where it is a run that isn't valid as a whole."""
        run = h.rlike(r"^[A-Z0-9]+[ \-][A-Z0-9 \-]+$") & (k.isNull() | ((k == "iban") & ~_sized(h)))
        whole = F.array(F.struct(k.alias("k"), F.coalesce(pseudonym(h, k, key), h).alias("r")))
        return F.when(run, _parts_of_run(h, key)).otherwise(whole)

    def body(t: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda h: let(kind_of(h), lambda k: hit(h, k)))
        parts = F.split(t, PATTERN, -1)
        joined = let(hits, lambda h: F.struct(F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.array_join(F.transform(F.get(h, i), lambda x: x["r"]), ""), F.lit("")))), "").alias("text"), F.filter(F.transform(F.flatten(h), lambda x: x["k"]), lambda k: k.isNotNull()).alias("kinds")))
        return joined

    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(GATE), let(text, body)).otherwise(plain)


def session_key(docs: DataFrame) -> str:
    return docs.sparkSession.conf.get(KEY_SETTING, KEY)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all columns stay in place. Without ``key`` the session's is used."""
    return docs.withColumn("text", treated(F.col("text"), key or session_key(docs))["text"])


def found(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, kinds in order of place. Without ``key`` the session's is used."""
    done = docs.select("doc_id", treated(F.col("text"), key or session_key(docs)).alias("__p"))
    return done.select("doc_id", F.col("__p.text").alias("text"), F.col("__p.kinds").alias("kinds"))
