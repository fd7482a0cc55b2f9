"""SQL for typed reading of VARIANT values, UTF-16 text and time, with the semantics of JSON documents made by JavaScript."""

from __future__ import annotations

# What identifiers, tokens and other formats look like.
ID = r"\\A[A-Za-z][A-Za-z0-9._:-]{0,127}\\z"
TOKEN = r"\\A[a-z][a-z0-9._-]{0,127}\\z"
SHA_256 = r"\\A[a-f0-9]{64}\\z"
MEDIA_TYPE = r"(?i)\\A[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+\\z"
CALENDAR_DATE = r"\\A[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"
AMOUNT = r"\\A(?:0|[1-9][0-9]*)(?:\\.[0-9]{1,6})?\\z"
CURRENCY = r"\\A[A-Z]{3}\\z"
#: Patterns that bound the length as the checks of their parts do.
BOUNDED = (ID, TOKEN, SHA_256, CURRENCY)
CONTROL = r"[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
#: Texts that surely have no control character, and those that surely have no active content besides (it has a <, a : or an =). As every character of them is one of UTF-16, their length is the number of characters.
FREE = r"[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{10000}-\\x{10FFFF}]"
PLAIN = FREE.replace("[^", "[^<:=")
#: Times and days that surely are.
_DAYS = "(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
SURE_DAY = rf"\\A[1-9][0-9]{{3}}-{_DAYS}\\z"
SURE_TIME = rf"\\A[1-9][0-9]{{3}}-{_DAYS}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.][0-9]{{1,6}})?Z\\z"
#: URLs that surely are: plain labels, of which the last one begins with a letter, and a plain path.
SURE_URL = r"\\Ahttps?://(?:[a-z0-9-]{1,63}[.]){1,9}[a-z][a-z0-9-]{0,62}(?:/[A-Za-z0-9/._-]{0,1000})?\\z"
#: White space as JavaScript has it; Java's own class is ASCII only.
SPACE = r"[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
ACTIVE = rf"(?i)<{SPACE}*/?{SPACE}*[a-z!][^>]*>|javascript{SPACE}*:|(?<![A-Za-z0-9_])on[a-z]+{SPACE}*="
ISO_TIME = r"\\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?\\z"


class Member(str):
    """SQL for a member as a variant, which knows where it is read from: what is asked of it is read there at once, and the member is not made into a variant of its own."""

    root: str
    path: str


def get(v: str, name: str) -> str:
    """A member, SQL NULL if it is absent (a JSON null is a variant)."""
    root, path = _place(v)
    member = Member(f"try_variant_get({root}, '{path}.{name}', 'variant')")
    member.root, member.path = root, f"{path}.{name}"
    return member


def _place(v: str) -> tuple[str, str]:
    return (v.root, v.path) if isinstance(v, Member) else (v, "$")


def read_as(v: str, kind: str) -> str:
    """A value as a type of Spark's, NULL if it cannot be one."""
    root, path = _place(v)
    return f"try_variant_get({root}, '{path}', '{kind}')"


def kind(v: str) -> str:
    """The schema of a value: for objects and arrays that of all that is in them, so it is only asked of what is likely neither."""
    return f"coalesce(schema_of_variant({v}), 'ABSENT')"


# What a value is is asked by casts that look at its own kind only: nothing but an object is a struct, nothing but an array an array, and of what JSON has only a string is binary.
def is_object(v: str) -> str:
    return f"({read_as(v, 'struct<>')} IS NOT NULL)"


def is_array(v: str) -> str:
    return f"({unread(v)} IS NOT NULL)"


def unread(v: str) -> str:
    """An array whose elements are not read: as long as the one that is there."""
    return read_as(v, "array<array<boolean>>")


def is_string(v: str) -> str:
    return f"({read_as(v, 'binary')} IS NOT NULL)"


def string(v: str) -> str:
    """The text of a string, else NULL."""
    return f"CAST({read_as(v, 'binary')} AS STRING)"


def number(v: str) -> str:
    """The double of a number, else NULL."""
    return f"CASE WHEN {read_as(v, 'binary')} IS NULL AND NOT {read_as(v, 'string')} IN ('true', 'false') THEN {read_as(v, 'double')} END"


def boolean(v: str) -> str:
    return f"if({kind(v)} = 'BOOLEAN', {read_as(v, 'boolean')}, NULL)"


def items(v: str) -> str:
    """The elements of an array, else none."""
    return f"coalesce({read_as(v, 'array<variant>')}, CAST(array() AS array<variant>))"


def records(v: str) -> str:
    """The objects among the elements of an array."""
    return f"filter({items(v)}, e -> {is_object('e')})"


def strings(v: str) -> str:
    """The strings among the elements of an array."""
    return f"transform(filter(coalesce({read_as(v, 'array<binary>')}, CAST(array() AS array<binary>)), e -> e IS NOT NULL), e -> CAST(e AS STRING))"


def keys(v: str) -> str:
    return f"map_keys({read_as(v, 'map<string,array<boolean>>')})"


def has(v: str, name: str) -> str:
    """Presence, null included."""
    return f"({get(v, name)} IS NOT NULL)"


def safe_integer(v: str) -> str:
    """The value of a safe integer, else NULL."""
    n = number(v)
    return f"if({n} = floor({n}) AND abs({n}) <= 9007199254740991, {n}, NULL)"


def utf16_length(s: str) -> str:
    return f"(octet_length(encode({s}, 'UTF-16BE')) DIV 2)"


def utf16_slice(s: str, start: str, end: str) -> str:
    """Code units start to end, as bytes: a cut inside a surrogate pair is no error."""
    return f"substring(encode({s}, 'UTF-16BE'), CAST(2 * {start} + 1 AS INT), CAST(greatest(0, 2 * ({end} - {start})) AS INT))"


def utf16(s: str) -> str:
    return f"encode({s}, 'UTF-16BE')"


#: Dates as people write them, with a time: weekday, day, month, year; or month, day, year. Groups: day, month (or month, day), year, hour, minute, second, zone.
_TIME = r"([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?(?: ?(Z|UTC?|GMT|[ECMP][SD]T)?([+-][0-9]{{2}}:?[0-9]{{2}})?)(?: ?\\([^()]*\\))?\\z"
_WEEKDAY = r"\\A(?:(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat)[a-z]*,? +)?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DAY_FIRST = f"(?i){_WEEKDAY}([0-9]{{1,2}})[ -]{_MONTH}[ -]([0-9]{{4}}),? +{_TIME}".replace("{{", "{").replace("}}", "}")
MONTH_FIRST = f"(?i){_WEEKDAY}{_MONTH} +([0-9]{{1,2}}),? +([0-9]{{4}}),? +{_TIME}".replace("{{", "{").replace("}}", "}")
#: ISO 8601 with what JavaScript takes besides: signed years of six digits, dates without a day or a month, the hour 24. Groups: year, month, day, hour, minute, second, zone.
ISO_WIDE = r"\\A([0-9]{4}|[+-][0-9]{6})(?:-([0-9]{2}))?(?:-([0-9]{2}))?T([0-9]{2}):([0-9]{2})(?::([0-9]{2}(?:[.][0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?\\z"
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
#: Hours behind UTC of the zones that have names.
_ZONES = {"EST": 5, "EDT": 4, "CST": 6, "CDT": 5, "MST": 7, "MDT": 6, "PST": 8, "PDT": 7}


def _moment(year: str, month: str, day: str, hour: str, minute: str, second: str, ahead: str, more: str = "TRUE") -> str:
    """A timestamp of numbers. A day of up to 31 that its month doesn't have goes on into the next one; the hour 24 is the next day's first, if nothing follows it. ahead: minutes before UTC."""
    whole = f"make_timestamp({year}, {month}, 1, {hour} % 24, {minute}, {second}, 'UTC') + make_dt_interval({day} - 1 + {hour} DIV 24, 0, -({ahead}), 0)"
    fits = f"{year} BETWEEN 1 AND 9999 AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 AND {minute} < 60 AND {second} < 60 AND ({hour} < 24 OR {hour} = 24 AND {minute} = 0 AND {second} = 0) AND {more}"
    return f"CASE WHEN {fits} THEN {whole} END"


def _offset(zone: str) -> str:
    """Minutes ahead of UTC of +hh:mm or +hhmm, 0 of none."""
    return f"coalesce(try_cast(concat(substr({zone}, 1, 1), '1') AS INT) * (60 * try_cast(substr({zone}, 2, 2) AS INT) + try_cast(right({zone}, 2) AS INT)), 0)"


def _inner(s: str, pattern: str, body) -> str:
    """The body over the groups of a pattern, which are worked out once; a group that isn't there is empty."""
    groups = f"array({', '.join(f'regexp_extract({s}, {chr(39)}{pattern}{chr(39)}, {k})' for k in range(1, 9 if pattern != ISO_WIDE else 8))})"
    return f"transform(array({groups}), g -> {body('g')})[0]"


def instant(s: str) -> str:
    """The timestamp of a date-time, else NULL: of what JavaScript's Date.parse takes, ISO 8601 and dates as people write them. Without a zone it is UTC. Years from 1 to 9999.

    The text is worked out once, however it is come by.
    """
    return f"transform(array({s}), t -> {_instant('t')})[0]"


def _instant(s: str) -> str:
    zoned = f"if({s} RLIKE '(Z|[+-][0-9]{{2}}:[0-9]{{2}})\\\\z', {s}, concat({s}, 'Z'))"
    full = f"regexp_replace({zoned}, '(T[0-9]{{2}}:[0-9]{{2}})(Z|[+-])', '$1:00$2')"
    plain = f"if({s} RLIKE '{ISO_TIME}', try_cast({full} AS TIMESTAMP), NULL)"
    number = lambda g, k, kind="INT", default=0: f"coalesce(try_cast({g}[{k}] AS {kind}), {default})"
    second = lambda g, k: number(g, k, "DECIMAL(16,6)")
    wide = _inner(s, ISO_WIDE, lambda g: _moment(number(g, 0), number(g, 1, default=1), number(g, 2, default=1), number(g, 3), number(g, 4), second(g, 5), _offset(f"{g}[6]"), f"NOT ({g}[1] = '' AND {g}[2] <> '') AND {g}[0] <> '-000000'"))
    month = lambda g, k: f"(2 + instr('{_MONTHS.lower()}', lower({g}[{k}]))) DIV 3"
    named = lambda g: "coalesce(element_at(map(" + ", ".join(f"'{z}', {-60 * h}" for z, h in _ZONES.items()) + f"), upper({g}[6])), 0)"
    said = lambda pattern, d, m: _inner(s, pattern, lambda g: _moment(number(g, 2), month(g, m), number(g, d), number(g, 3), number(g, 4), second(g, 5), f"{named(g)} + {_offset(f'{g}[7]')}"))
    return f"coalesce({plain}, CASE WHEN {s} RLIKE '{ISO_WIDE}' THEN {wide} WHEN {s} RLIKE '{DAY_FIRST}' THEN {said(DAY_FIRST, 0, 1)} WHEN {s} RLIKE '{MONTH_FIRST}' THEN {said(MONTH_FIRST, 1, 0)} END)"


def same_multiset(a: str, b: str) -> str:
    """Two variants are arrays with the same elements in some order."""
    text = lambda v: f"array_sort(transform({items(v)}, e -> coalesce({string('e')}, to_json(e), '')))"
    return f"({is_array(a)} AND {is_array(b)} AND {text(a)} = {text(b)})"


# --- URLs, as the WHATWG standard's parser takes them -------------------------------------------------------------------------------

#: What the parser takes off the ends, and out of the middle.
_ENDS, _MIDDLE = r"\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z", r"[\\t\\n\\r]"
#: After http: or https:, any slashes of either kind; then the authority.
_AUTHORITY = r"(?i)\\A(https?):[/\\\\]*([^/\\\\?#]*)"
#: What no domain may hold, once it is decoded.
_FORBIDDEN = r"[\\x00-\\x20\\x7F#%/:<>?@\\[\\\\\\]^`{|}\\x{AD}]"
_NUMBER = "(?:0[xX][0-9a-fA-F]*|[0-9]+)"
_H16 = "[0-9a-fA-F]{1,4}"
_V4 = "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"


def _ipv6(h: str) -> str:
    """Whether what stands between brackets is an IPv6 address: eight groups, or fewer and one ::, of which two may be an IPv4 address."""
    tail = f"if({h} RLIKE '{_V4}\\\\z', regexp_replace({h}, '{_V4}\\\\z', '0:0'), {h})"
    four = f"coalesce(forall(split(regexp_extract({h}, '({_V4})\\\\z', 1), '[.]'), p -> p = '' OR (CAST(p AS INT) < 256 AND (p = '0' OR p NOT LIKE '0%'))), TRUE)"
    groups = "size(filter(split(w, ':'), p -> p <> ''))"
    whole = f"w RLIKE '\\\\A{_H16}(:{_H16}){{7}}\\\\z'"
    short = f"(w LIKE '%::%' AND NOT w LIKE '%::%::%' AND NOT w LIKE '%:::%' AND {groups} <= 7 AND w RLIKE '\\\\A(({_H16}:)*{_H16})?::(({_H16}:)*{_H16})?\\\\z')"
    return f"({four} AND transform(array({tail}), w -> {whole} OR {short})[0])"


def _ipv4(h: str) -> str:
    """Whether a domain whose last label is a number is an IPv4 address: at most four numbers (decimal, octal or hexadecimal), all but the last under 256, the last filling the rest."""
    value = "CASE WHEN p RLIKE '^0[xX]' THEN coalesce(CAST(conv(if(length(p) > 2, substr(p, 3), '0'), 16, 10) AS DECIMAL(20,0)), 0) WHEN p RLIKE '^0[0-7]+$' THEN CAST(conv(p, 8, 10) AS DECIMAL(20,0)) WHEN p RLIKE '^0[0-9]+$' THEN -1 ELSE try_cast(p AS DECIMAL(20,0)) END"
    numbers = f"transform(split(regexp_replace({h}, '[.]\\\\z', ''), '[.]'), p -> if(p RLIKE '^{_NUMBER}$' AND length(p) < 20, {value}, -1))"
    fits = "size(n) <= 4 AND size(filter(n, (v, k) -> NOT (v >= 0 AND v < if(k = size(n) - 1, CAST(pow(256, 5 - size(n)) AS DECIMAL(20,0)), 256)))) = 0"
    return f"coalesce(transform(array({numbers}), n -> {fits})[0], FALSE)"


def web_url(s: str) -> str:
    """How the standard's parser takes a text as an absolute http or https URL: 'ok', 'credentials' (a name or a password before the host), or 'invalid'. NULL of NULL.

    Spaces and controls at the ends, tabs and line ends, backslashes and missing slashes are repaired, as the parser does. Hosts: IPv6 in brackets, IPv4 in all its forms, domains without
    forbidden characters once they are percent-decoded. Labels beyond ASCII count as domains if they are letters, marks, digits, hyphens and dots (IDNA's tables are not looked up).
    """
    cleaned = f"regexp_replace(regexp_replace({s}, '{_ENDS}', ''), '{_MIDDLE}', '')"
    authority = f"if(u RLIKE '{_AUTHORITY}', regexp_extract(u, '{_AUTHORITY}', 2), NULL)"
    user = "if(instr(a, '@') > 0, substr(a, 1, length(a) - instr(reverse(a), '@')), '')"
    rest = "if(instr(a, '@') > 0, right(a, instr(reverse(a), '@') - 1), a)"
    port = "regexp_extract(r, ':([0-9]*)\\\\z', 1)"
    host = "regexp_replace(r, ':[0-9]*\\\\z', '')"
    good_port = f"coalesce(try_cast(if({port} = '', '0', {port}) AS INT) <= 65535, FALSE)"
    decoded = "coalesce(try_url_decode(replace(h, '+', '%2B')), '%')"
    ascii = "lower(translate(d, '\u3002\uff0e\uff61', '...'))"
    numeric = f"n RLIKE '(\\\\A|[.]){_NUMBER}[.]?\\\\z'"
    domain = f"n <> '' AND NOT n RLIKE '{_FORBIDDEN}' AND NOT n RLIKE '[^\\\\x00-\\\\x7F\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}.-]' AND if({numeric}, {_ipv4('n')}, NOT n RLIKE '[.][.].|\\\\A[.]+.' OR n RLIKE '\\\\A[\\\\x00-\\\\x7F]*\\\\z')"
    fits = f"if(h LIKE '[%', h LIKE '%]' AND {_ipv6('substr(h, 2, length(h) - 2)')}, transform(array({decoded}), d -> transform(array({ascii}), n -> {domain})[0])[0])"
    inner = f"transform(array({host}), h -> CASE WHEN NOT ({good_port} AND {fits}) THEN 'invalid' WHEN replace({user}, ':', '') <> '' THEN 'credentials' ELSE 'ok' END)[0]"
    return f"transform(array({cleaned}), u -> transform(array({authority}), a -> CASE WHEN {s} IS NULL THEN NULL WHEN a IS NULL THEN 'invalid' ELSE transform(array({rest}), r -> {inner})[0] END)[0])[0]"
