"""Key and text expressions: version ids, percent-encoding, sizes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of version ids.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def version_id(order: Column) -> Column:
    """13 base-32 digits of a non-negative order, most significant first."""
    digit = lambda i: F.substr(F.lit(ALPHABET), (F.shiftright(order, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in range(12, -1, -1)])


def parse_version_id(text: Column) -> Column:
    """The order that an id names (a decimal, as it may take 64 bits), or null."""
    place = lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("decimal(20,0)")
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("decimal(38,0)"), lambda s, c: (s * F.lit(32) + place(c)).cast("decimal(38,0)"))
    return F.when((F.length(text) == 13) & text.rlike(f"^[{ALPHABET}]*$") & (total < F.lit(str(1 << 64)).cast("decimal(20,0)")), total.cast("decimal(20,0)"))


def percent_encode(text: Column, slash: bool = False) -> Column:
    """All but unreserved characters (and the slash, unless asked for) as %XX of their UTF-8 octets."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return out if slash else F.replace(out, F.lit("%2F"), F.lit("/"))


def query_pairs(query: Column) -> Column:
    """Names and values of a query string, both decoded; a name without '=' has an empty value."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    one = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"), F.when(F.instr(p, "=") > 0, F.try_url_decode(F.substr(p, F.instr(p, "=") + F.lit(1)))).otherwise("").alias("value"))
    return F.transform(pairs, one)


def fixed_prefix(key: Column, size: int) -> Column:
    """The first size characters; null where the key is shorter."""
    return F.when(F.length(key) >= size, F.substring(key, 1, size))


def capped_prefix(key: Column, size: int) -> Column:
    return F.substring(key, 1, size)


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two keys share."""
    n = F.least(F.length(a), F.length(b))
    differ = F.transform(F.sequence(F.lit(1), n + 1), lambda i: (i > n) | (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return (F.array_position(differ, True) - 1).cast("int")


def human_size(size: Column) -> Column:
    """The largest binary unit that a size is a whole number of."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(["KiB", "MiB", "GiB", "TiB", "PiB"], 1):
        whole = (size >= 1 << (10 * k)) & (size % F.lit(1 << (10 * k)) == 0)
        text = F.when(whole, F.concat(F.shiftright(size, 10 * k).cast("string"), F.lit(f" {unit}"))).otherwise(text)
    return text


def bucket_name_valid(name: Column) -> Column:
    """3 to 63 of a-z, 0-9, dot and hyphen; each label begins and ends alphanumeric; no IPv4 address; reserved affixes refused."""
    label = "[a-z0-9]([a-z0-9-]*[a-z0-9])?"
    shape = F.length(name).between(3, 63) & name.rlike(rf"^{label}(\.{label})*$")
    reserved = name.rlike(r"^(xn--|sthree-|amzn-s3-demo-)") | name.rlike(r"(-s3alias|--ol-s3|\.mrap|--x-s3|--table-s3)$")
    return shape & ~name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~reserved


def scaled(value: Column, units: list[str], step: float = 1000.0, joined: str = " ") -> Column:
    """A quantity in the largest unit that leaves it at 1 or more, to three figures; whole in the first unit."""
    figures = lambda v, n: F.format_string(f"%.{n}f", F.bround(v, n))
    text = lambda v: F.when(v >= 100, figures(v, 0)).when(v >= 10, figures(v, 1)).otherwise(figures(v, 2))
    out = F.concat(figures(value.cast("double"), 0), F.lit((joined if units[0] else "") + units[0]))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(value >= step**k, F.concat(text(value / step**k), F.lit(joined + unit))).otherwise(out)
    return out


def count_text(value: Column) -> Column:
    return scaled(value, ["", "K", "M", "G"], joined="")


def rate_text(per_second: Column) -> Column:
    return F.concat(scaled(per_second, ["B", "kB", "MB", "GB", "TB"]), F.lit("/s"))


def client_id(name: Column) -> Column:
    """The id that a client's name gives in its one spelling (a decimal, as it may take 64 bits), or null."""
    digits = F.regexp_extract(name, r"^client-([1-9]\d{0,19})$", 1).try_cast("decimal(20,0)")
    return F.when(digits < F.lit(str(1 << 64)).cast("decimal(20,0)"), digits)


def header_id(text: Column) -> Column:
    """A rule's id as a header carries it: as it is if it is printable ASCII without quotes, backslashes or outer spaces, else percent-encoded whole."""
    plain = text.rlike(r'^[ !#-\[\]-~]*$') & ~text.startswith(" ") & ~text.endswith(" ")
    return F.when(plain, text).otherwise(percent_encode(text, slash=True))


SEGMENT, TAG = 64 * 1024, 16


def sealed_size(plain: Column) -> Column:
    """Bytes of a file sealed in segments with a tag each; an empty file has one segment."""
    return plain + TAG * F.greatest(F.ceil(plain / SEGMENT), F.lit(1))


def plain_size(sealed: Column) -> Column:
    """The bytes that a sealed file holds, or null where none seals to that size."""
    full, rest = F.floor(sealed / (SEGMENT + TAG)), sealed % (SEGMENT + TAG)
    held = F.when((rest == 0) & (full > 0), full * SEGMENT).when(rest >= TAG, full * SEGMENT + rest - TAG)
    return F.when(sealed_size(held) == sealed, held)


LEAST_PART, MOST_PART, MOST_PARTS = 5 << 20, 5 << 30, 10_000


def run_size(size: Column, buffer: Column, block: Column) -> Column:
    """The bytes of each run of an upload: the fewest whole units (blocks, or segments where a block is none) within the part sizes with which 10,000 runs hold the object; as much as the buffer takes where no size is stated; null where nothing fits."""
    held = F.floor(F.least(F.coalesce(buffer, F.lit(MOST_PART).cast("long")), F.lit(MOST_PART).cast("long")) / SEGMENT) * SEGMENT
    unit = F.when((block >= SEGMENT) & (block % SEGMENT == 0) & (block <= held), block).otherwise(F.lit(SEGMENT).cast("long"))
    most, least = F.floor(held / unit) * unit, F.ceil(F.lit(LEAST_PART) / unit) * unit
    run = F.when(size.isNull(), most).otherwise(F.greatest(F.ceil(F.ceil(size / MOST_PARTS) / unit) * unit, least))
    return F.when((run >= least) & (run <= most), run)


def in_range(hash_: Column, size: int) -> Column:
    """A 64-bit hash (unsigned, as a decimal) scaled into 0 up to size, by its high bits rather than a remainder."""
    return F.floor(hash_ * F.lit(size).cast("decimal(10,0)") / F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("long")


def separator(a: Column, b: Column) -> Column:
    """The shortest ASCII key at least a and below b, where a < b; a itself where none is shorter."""
    n, least = shared_prefix(a, b), F.least(F.length(a), F.length(b))
    at = lambda x, i: F.ascii(F.substr(x, i, F.lit(1)))
    cut = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.char(at(a, i) + 1))
    later = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: (i > n + 1) & (at(a, i) < 127))
    follow = F.get(later, 0)
    return F.when(n >= least, a).when(at(a, n + 1) + 1 < at(b, n + 1), cut(n + 1)).when(follow.isNotNull() & (follow < F.length(a)), cut(follow)).otherwise(a)


def varint(number: Column) -> Column:
    """A non-negative number in groups of 7 bits from the lowest, a high bit on all but the last, as hexadecimal."""
    left = lambda i: F.call_function("shiftright", number, F.lit(7 * i))
    octet = lambda i: left(i).bitwiseAND(F.lit(127).cast("long")) + (F.when(left(i + 1) > 0, 128).otherwise(0) if i < 8 else 0)
    digits = lambda i: F.lpad(F.lower(F.hex(octet(i))), 2, "0")
    return F.when(number.isNotNull(), F.concat_ws("", digits(0), *[F.when(left(i) > 0, digits(i)) for i in range(1, 9)]))


LOW = 56


def halves(number: Column) -> tuple[Column, Column]:
    """The low 56 bits of a non-negative decimal below 2^119, and those above."""
    return (number % F.lit(1 << LOW)).cast("long"), F.call_function("div", number, F.lit(1 << LOW)).cast("long")


def wide_varint(low: Column, high: Column) -> Column:
    """A varint of a number in halves, which may take more than 64 bits."""
    full = [F.hex(F.call_function("shiftright", low, F.lit(7 * i)).bitwiseAND(F.lit(127).cast("long")) + 128) for i in range(LOW // 7)]
    return F.when(high == 0, varint(low)).otherwise(F.concat(F.lower(F.concat(*full)), varint(high)))


def read_varint(digits: Column) -> Column:
    """(number, size) of a varint at the start of hexadecimal digits; null where it doesn't end within the 63 bits of a long."""
    octets = F.transform(F.sequence(F.lit(0), F.least(F.floor(F.length(digits) / 2), F.lit(9)).cast("int") - 1), lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    size = F.array_position(F.transform(octets, lambda x: x < 128), True).cast("int")
    value = F.aggregate(F.transform(F.slice(octets, 1, size), lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(127).cast("long")), 7 * i)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(size > 0, F.struct(value.alias("number"), size.alias("size")))


def sliced(text: Column) -> Column:
    """A text's octets with their number before them, as hexadecimal."""
    octets = F.encode(text, "UTF-8")
    return F.concat(varint(F.length(octets).cast("long")), F.lower(F.hex(octets)))


def read_slice(digits: Column) -> Column:
    """The text of a length-prefixed slice, or null where it is cut."""
    head = read_varint(digits)
    held = F.substr(digits, 2 * head["size"] + 1, (2 * head["number"]).cast("int"))
    return F.when(F.length(held) == 2 * head["number"], F.decode(F.unhex(held), "UTF-8"))
