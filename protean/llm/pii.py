"""Format-preserving pseudonyms for personal data, in SQL functions only.

Numbers and dates that pass their validation are permuted by a keyed Feistel network inside the
set of values of their own format: a pseudonym is again a valid value of that format, two values
never share one, and equal values get equal pseudonyms in every document, whatever their separators.

| kind   | validated by                         | permuted set |
|--------|--------------------------------------|--------------|
| card   | Luhn sum, 13 to 19 digits            | inner digits; first digit kept, check digit made anew |
| iban   | remainder 1 modulo 97                | account part; country kept, check digits made anew |
| ssn    | no forbidden area, group or serial   | the 898 x 99 x 9999 allowed numbers |
| ip     | four octets of 0 to 255              | all 2^32 addresses |
| ipv6   | eight groups, or fewer around ``::`` | hexadecimal digits, class by class |
| date   | a day of the calendar                | the 146,097 days of its 400-year cycle |
| phone  | see below                            | ten digits, or those behind a country code |
| email  | local part, @, domain                | letters and digits of the local part, class by class |
| secret | 32 or more hexadecimal digits        | the digits, class by class |

Account numbers may be written in groups of four and in lower case, cards with spaces, hyphens or dots,
SSNs with hyphens or spaces, or bare behind ``SSN`` or ``social security number``. Dates are year-month-day
(``-``, ``/`` or ``.``), month/day/year (day/month/year where only that is a day), day.month.year, or with
the English name of the month. Phones are ``+`` and 8 to 15 digits in groups, or ten digits as ``(212) 555-0134``
or ``212-555-0134``; of ten digits behind nothing or ``+1`` the first of the area and of the exchange stay
in their class (0 and 1, or 2 to 9), so a number that fits the plan gives one that does. Elsewhere the
country code (the first group) stays. A date in words or with its day first is walked on until it is of its own
form again. Equal values in different forms of one kind are equal pseudonyms but for IPv6 groups written
short and dates, whose form is a format of its own.

No row is moved: the operator is a projection, without shuffle or Python.

Defined results: null text stays null with nothing found; empty text stays empty; candidates that
fail their validation stay as they are; null and repeated identifiers pass through; very long texts
are treated whole; other columns are ignored by the query and kept by ``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The candidate patterns, in order of preference.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS) + ")"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)|[a-z]{2}[0-9]{2}(?:[a-z0-9]{11,30}|(?: [a-z0-9]{4}){2,7}(?: [a-z0-9]{1,4})?))(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F]*:[0-9a-fA-F:]*[0-9])(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9])\+?[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?=(?:[ .()-]{0,2}[0-9]){7,14}(?![ .-]?[0-9]))(?:[ .-]?\(?[0-9]{1,12}\)?){1,6}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.+-])[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])",
    "ip": rf"(?<![0-9])(?<![0-9]\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "date": rf"(?<![0-9-])[0-9]{{4}}([./-])[0-9]{{2}}\2[0-9]{{2}}(?![0-9-])|(?<![0-9./-])(?:[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})(?![0-9/-])|(?<![0-9A-Za-z]){_MONTH} [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])|(?<![0-9A-Za-z.,-])[0-9]{{1,2}} {_MONTH} [0-9]{{4}}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}([ -])[0-9]{2}\3[0-9]{4}(?![0-9-])|(?<=(?:SSN|ssn|[Ss]ocial [Ss]ecurity(?: [Nn]umber)?)[ :#]{1,3})[0-9]{9}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ .-])[0-9]{4}\4[0-9]{4}\4[0-9]{1,7}|[0-9]{4}([ .-])[0-9]{6}\5[0-9]{5}|[0-9]{13,19})(?![0-9])",
}


_DATE_FORMS = rf"^([0-9]{{4}}[./-][0-9]{{2}}[./-][0-9]{{2}}|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}|{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}})$"


def _date_parts(m: str) -> str:
    """SQL of the date in ``m`` as (y, m, d), null fields where there is none; a form's own reading."""
    part = lambda sep, k: f"int(element_at(split({m}, '{sep}'), {k}))"
    month = lambda k: "array_position(array(" + ", ".join(f"'{x[:3]}'" for x in _MONTHS) + f"), substr(element_at(split({m}, '[ ,]+'), {k}), 1, 3))"
    a, b, y = part("/", 1), part("/", 2), part("/", 3)
    return f"""case when {m} rlike '^[0-9]{{4}}[./-]' then named_struct('y', {part('[./-]', 1)}, 'm', {part('[./-]', 2)}, 'd', {part('[./-]', 3)})
        when {m} like '%/%' and {_is_day(y, a, b)} then named_struct('y', {y}, 'm', {a}, 'd', {b})
        when {m} like '%/%' then named_struct('y', {y}, 'm', {b}, 'd', {a})
        when {m} like '%.%' then named_struct('y', {part('[.]', 3)}, 'm', {part('[.]', 2)}, 'd', {part('[.]', 1)})
        when {m} like '%,%' then named_struct('y', {part('[ ,]+', 3)}, 'm', int({month(1)}), 'd', {part('[ ,]+', 2)})
        else named_struct('y', {part(' ', 3)}, 'm', int({month(2)}), 'd', {part(' ', 1)}) end"""


def _is_day(y: str, m: str, d: str) -> str:
    """SQL: there is such a day. Years of a 400-year cycle are alike."""
    return f"coalesce({m} between 1 and 12 and {d} between 1 and day(last_day(make_date({y} % 400 + 2000, least(greatest({m}, 1), 12), 1))), false)"


#: What every candidate begins with: only there are the patterns tried, as most places of a text are inside words.
#: A letter follows no letter or digit, and an address, account, secret or month must be ahead; a digit follows no digit.
START = (
    r"(?=[A-Za-z0-9+(:._%-])(?:(?=[A-Za-z])(?<![0-9A-Za-z])(?=(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@|[A-Za-z]{2}[0-9]{2}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{1,4}:|"
    rf"{_MONTH} [0-9])|(?=[0-9])(?<![0-9])|(?=[+(:._%-]))"
)


def _union() -> str:
    """One pattern of all kinds; the groups that separators repeat are counted through it, in this order."""
    return f"{START}(?:{'|'.join(PATTERNS.values())})"


def _text(s: str) -> str:
    """An SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(m: str) -> str:
    return f"""case when {m} like '%@%' then 'email' when {m} like '%:%' then 'ipv6'
        when {m} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' and length({m}) <= 15 and not {m} rlike '[0-9]{{4}}' then 'ip'
        when {m} rlike '{_DATE_FORMS}' then 'date'
        when {m} like '%(%' or {m} like '+%' or {m} rlike '^[0-9]{{3}}([ .-])[0-9]{{3}}[ .-][0-9]{{4}}$' then 'phone'
        when {m} rlike '^([0-9]{{3}}[ -][0-9]{{2}}[ -][0-9]{{4}}|[0-9]{{9}})$' then 'ssn' when {m} rlike '^[0-9 .-]+$' then 'card'
        when {m} rlike '^([0-9a-f]+|[0-9A-F]+)$' and length({m}) >= 32 then 'secret' else 'iban' end"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Luhn sum of the digit string ``d``; 0 modulo 10 for a valid one."""
    n = f"int(substr({d}, -k, 1))"
    return f"aggregate(sequence(1, length({d})), 0, (a, k) -> a + case when k % 2 = 1 then {n} else 2 * {n} - if({n} > 4, 9, 0) end)"


def _mod97(s: str) -> str:
    """Remainder of an account number's digits, letters standing for 10 to 35."""
    c = f"ascii(substr({s}, k, 1))"
    return f"aggregate(sequence(1, length({s})), 0, (a, k) -> if({c} < 58, a * 10 + {c} - 48, a * 100 + {c} - 55) % 97)"


def _valid(kind: str, m: str) -> str:
    d = _digits(m)
    return f"""case {kind} when 'card' then exists(array({d}), t -> {_luhn('t')} % 10 = 0 and cast(t as decimal(20, 0)) > 0)
        when 'date' then exists(array({_date_parts(m)}), t -> {_is_day('t.y', 't.m', 't.d')})
        when 'ssn' then not (substr({d}, 1, 3) in ('000', '666') or {d} like '9%' or substr({d}, 4, 2) = '00' or {d} like '%0000')
        when 'phone' then length({d}) between 8 and 15
        when 'iban' then exists(array(upper(replace({m}, ' ', ''))), t -> length(t) between 15 and 34 and {_mod97("concat(substr(t, 5), substr(t, 1, 4))")} = 1) else true end"""


#: Steps after which a walk through days of another form is sure to have ended (each ends with probability 0.6).
WALK = 64
#: A number of the numbering plan's product back as ten digits.
PLAN_BACK = """concat(string({b} div ({size} * 1000000L) div 100 + {low1}), lpad(string({b} div ({size} * 1000000L) % 100), 2, '0'),
    string({b} div 1000000L % {size} + {low4}), lpad(string({b} % 1000000L), 6, '0'))"""


class _Feistel:
    """SQL text of keyed permutations."""

    def __init__(self, key: str, rounds: int):
        self.key, self.rounds = _text(key), rounds

    def _hash(self, kind: str, r: str, value: str) -> str:
        """A keyed hash of 60 bits."""
        return f"cast(conv(substr(sha2(concat_ws(':', {self.key}, '{kind}', {r}, {value}), 256), 1, 15), 16, 10) as bigint)"

    def pair(self, kind: str, x: str, a: int | str, b: int) -> str:
        """Permutes the numbers below a * b: either half is moved by a hash of the other. ``a`` may be an SQL expression."""
        step = lambda half, other, m: f"pmod({half} + {self._hash(kind, 'r', other)}, bigint({m}))"
        return f"""aggregate(sequence(1, {self.rounds}), named_struct('l', bigint(({x}) div {b}L), 'r', bigint(({x}) % {b}L)),
            (s, r) -> if(r % 2 = 1, named_struct('l', {step('s.l', 's.r', a)}, 'r', s.r), named_struct('l', s.l, 'r', {step('s.r', 's.l', b)})),
            s -> s.l * {b}L + s.r)"""

    def chars(self, kind: str, s: str) -> str:
        """Permutes letters and digits, each within its class (a to f or A to F for ``secret``)."""
        last = 6 if kind in ("secret", "ipv6") else 26

        def moved(half: str, other: str) -> str:
            c = f"ascii(substr({half}, j, 1))"
            by = f"xxhash64({self._hash(kind, 'r', other)}, j)"
            move = lambda base, m: f"chr({base} + pmod({c} - {base} + {by}, {m}))"
            return f"if(length({half}) = 0, '', array_join(transform(sequence(1, length({half})), j -> case when {c} < 58 then {move(48, 10)} when {c} < 91 then {move(65, last)} else {move(97, last)} end), ''))"

        left, right = "substr(t, 1, length(t) div 2)", "substr(t, length(t) div 2 + 1)"
        # the class pattern is hashed with the half, so that it may differ between values
        return f"aggregate(sequence(1, {self.rounds}), {s}, (t, r) -> if(r % 2 = 1, concat({moved(left, right)}, {right}), concat({left}, {moved(right, left)})))"


def _laid(m: str, new: str) -> str:
    """The letters and digits of ``new`` in the places of those of ``m``; other characters stay."""
    at = f"length(regexp_replace(substr({m}, 1, i), '[^0-9A-Za-z]', ''))"
    # ``new`` is bound first, so that it is computed once and not for each character
    return f"element_at(transform(array({new}), z -> array_join(transform(sequence(1, length({m})), i -> if(substr({m}, i, 1) rlike '[0-9A-Za-z]', substr(z, {at}, 1), substr({m}, i, 1))), '')), 1)"


def _pseudonym(kind: str, m: str, f: _Feistel) -> str:
    d = _digits(m)
    bare = f"regexp_replace({m}, '[^0-9A-Za-z]', '')"
    local = f"substring_index({m}, '@', 1)"

    def let(value: str, body: str, name: str) -> str:
        """``body`` with ``name`` bound to ``value``, computed once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    card = let(f"concat(substr({d}, 1, 1), {f.chars('card', f'substr({d}, 2, length({d}) - 2)')})", _laid(m, f"concat(b, (10 - {_luhn('concat(b, 0)')} % 10) % 10)"), "b")
    account = "upper(regexp_replace({m}, ' ', ''))".replace("{m}", m)
    check = f"lpad(string(98 - {_mod97('concat(b, substr(c, 1, 2), 0, 0)')}), 2, '0')"
    iban = let(account, let(f.chars("iban", "substr(c, 5)"), _laid(m, f"if({m} rlike '[a-z]', lower(concat(substr(c, 1, 2), {check}, b)), concat(substr(c, 1, 2), {check}, b))"), "b"), "c")
    area = f"int(substr({d}, 1, 3))"
    ssn_at = f"(bigint({area} - 1 - if({area} > 666, 1, 0)) * 99L + int(substr({d}, 4, 2)) - 1) * 9999L + int(substr({d}, 6, 4)) - 1"
    new_area = "(b div 989901L)"
    ssn = let(f.pair("ssn", ssn_at, 898 * 99, 9999), _laid(m, f"concat(lpad(string({new_area} + 1 + if({new_area} >= 665, 1, 0)), 3, '0'), lpad(string(b div 9999L % 99L + 1), 2, '0'), lpad(string(b % 9999L + 1), 4, '0'))"), "b")
    octet = lambda k: f"bigint(element_at(split({m}, '[.]'), {k}))"
    ip = let(f.pair("ip", f"(({octet(1)} * 256L + {octet(2)}) * 256L + {octet(3)}) * 256L + {octet(4)}", 65536, 65536), "concat_ws('.', b div 16777216L, b div 65536L % 256L, b div 256L % 256L, b % 256L)", "b")
    # 146,097 days are 189 x 773: a 400-year cycle is a product
    new_day = "date_add(date'2000-01-01', int(b))"
    first = f"({m} rlike '^[0-9]{{1,2}}/' and int(substring_index({m}, '/', 1)) > 12)"  # a form with the day first where the other reading is no day
    day = "datediff(make_date(c.y % 400 + 2000, c.m, c.d), date'2000-01-01')"
    walk = lambda v: f.pair("date", v, 189, 773)
    # values of one form only map to that form: the permutation is walked until the day is one of its own, nearly always within a few steps
    own = "day(date_add(date'2000-01-01', int(s.l))) > 12"
    walked = f"aggregate(sequence(1, {WALK}), named_struct('l', bigint({day}), 'r', 0), (s, k) -> if(s.r > 0 and {own}, s, named_struct('l', {walk('s.l')}, 'r', 1)), s -> s.l)"
    moved = f"if({first}, {walked}, {walk(day)})"
    year = f"lpad(string(year({new_day}) - 2000 + 400 * (c.y div 400)), 4, '0')"
    month, dom = f"month({new_day})", f"day({new_day})"
    two = lambda v: f"lpad(string({v}), 2, '0')"
    word = lambda v, k: f"if(length(element_at(split({m}, '[ ,]+'), {k})) = 3, substr({v}, 1, 3), {v})"
    name = "element_at(array(" + ", ".join(f"'{x}'" for x in _MONTHS) + f"), {month})"
    written = f"""case when {m} rlike '^[0-9]{{4}}[./-]' then concat_ws(substr({m}, 5, 1), {year}, {two(month)}, {two(dom)})
        when {first} then concat_ws('/', {two(dom)}, {two(month)}, {year})
        when {m} like '%/%' then concat_ws('/', {two(month)}, {two(dom)}, {year})
        when {m} like '%.%' then concat_ws('.', {two(dom)}, {two(month)}, {year})
        when {m} like '%,%' then concat({word(name, 1)}, ' ', {dom}, ', ', {year})
        else concat({dom}, ' ', {word(name, 2)}, ' ', {year}) end"""
    date = let(_date_parts(m), let(moved, written, "b"), "c")
    # ten digits by the numbering plan: the first of the area and of the exchange stay in their class
    ten = f"({m} not like '+%' or {m} rlike '^[+]1[^0-9]' or length({d}) = 11 and {m} like '+1%') and length({d}) between 10 and 13"
    digit = lambda k: f"int(substr(c, {k}, 1))"
    size = lambda k: f"if({digit(k)} < 2, 2, 8)"
    low = lambda k: f"if({digit(k)} < 2, 0, 2)"
    upper_part = f"((bigint({digit(1)} - {low(1)}) * 100 + int(substr(c, 2, 2))) * {size(4)} + {digit(4)} - {low(4)}) * 100 + int(substr(c, 5, 2))"
    plan = f.pair("phone", f"({upper_part}) * 10000L + int(substr(c, 7, 4))", f"{size(1)} * {size(4)} * 10000L", 10000)
    local_ten = let(f"substr({d}, -10)", let(plan, _laid(m, f"concat(substr({d}, 1, length({d}) - 10), {PLAN_BACK.format(b='b', size=size(4), low1=low(1), low4=low(4))})"), "b"), "c")
    code = f"length(regexp_extract({m}, '^[+]([0-9]{{1,3}})', 1))"
    abroad = let(f"concat(substr({d}, 1, {code}), {f.chars('phone', f'substr({d}, {code} + 1)')})", _laid(m, "b"), "b")
    phone = f"if({ten}, {local_ten}, {abroad})"
    email = let(f.chars("email", f"regexp_replace({local}, '[^0-9A-Za-z]', '')"), f"concat({_laid(local, 'b')}, substr({m}, length({local}) + 1))", "b")
    secret = f.chars("secret", bare)
    ipv6 = let(f.chars("ipv6", bare), _laid(m, "b"), "b")
    return f"case {kind} when 'card' then {card} when 'iban' then {iban} when 'ssn' then {ssn} when 'ip' then {ip} when 'ipv6' then {ipv6} when 'date' then {date} when 'phone' then {phone} when 'email' then {email} else {secret} end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", rounds: int = 10) -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and two more columns (or new values of them): n_found and kinds.

    ``key`` is the secret; whoever has it can link or reverse the pseudonyms.
    """
    f, union = _Feistel(key, rounds), _union()
    tag = "_pii"
    while any(c.startswith(tag) for c in docs.columns):  # names of its own, whatever the table's are
        tag += "_"
    some, found, new, rest = (f"{tag}_{c}" for c in ("some", "found", "new", "rest"))
    text = F.col(text_col)
    work = (
        docs.withColumn(some, F.coalesce(text.rlike(union), F.lit(False)))  # most texts end here
        .withColumn(found, F.when(F.col(some), F.regexp_extract_all(text, F.lit(union), F.lit(0))))
        .withColumn(found, F.expr(f"transform({found}, m -> named_struct('m', m, 'kind', {_kind('m')}))"))
        .withColumn(found, F.expr(f"transform({found}, p -> named_struct('m', p.m, 'kind', if({_valid('p.kind', 'p.m')}, p.kind, null)))"))
        .withColumn(new, F.expr(f"transform({found}, p -> if(p.kind is null, p.m, {_pseudonym('p.kind', 'p.m', f)}))"))
        .withColumn(rest, F.when(F.col(some), F.split(text, union, -1)))
    )
    whole = F.expr(f"concat({rest}[0], array_join(zip_with({new}, slice({rest}, 2, size({new})), (a, b) -> concat(a, b)), ''))")
    n = F.expr(f"size(filter({found}, p -> p.kind is not null))")
    kinds = F.expr(f"array_join(array_sort(array_distinct(filter(transform({found}, p -> p.kind), k -> k is not null))), ',')")
    return (
        work.withColumn(text_col, F.when(F.col(some), whole).otherwise(text))
        .withColumn("n_found", F.when(F.col(some), n).otherwise(F.lit(0)).cast("long"))
        .withColumn("kinds", F.coalesce(kinds, F.lit("")))
        .drop(some, found, new, rest)
    )
