"""Scalar functions over columns; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label tiers in order, and those that count as positive.
LABEL_ORDER = ["skip", "drop", "meh", "like", "love", "obsessed"]
POSITIVE_LABELS = ["like", "love", "obsessed"]
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sanitize_title(c: Column) -> Column:
    """A title that can name a file: colon to ' -', other illegal signs dropped, white space collapsed."""
    dropped = F.regexp_replace(F.replace(c, F.lit(":"), F.lit(" -")), r'[\\/*?"<>|]', "")
    return F.regexp_replace(F.regexp_replace(dropped, r"^\s+|\s+$", ""), r"\s+", " ")


def artifact_name(title: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("[Ch "), first.cast("string"), F.lit(" - Ch "), last.cast("string"), F.lit("] "), sanitize_title(title), F.lit(".epub"))


def base_url(c: Column) -> Column:
    return F.regexp_extract(c, "^(https?://[^/]+)", 1)


def url_join(base: Column, href: Column) -> Column:
    """The address that ``href`` stands for on the page ``base``: absolute, ``//host``, host-relative,
    ``?query``, ``#part`` and relative references, with ``.`` and ``..`` steps taken."""
    page = F.regexp_replace(base, "#.*$", "")
    bare = F.regexp_replace(page, r"\?.*$", "")
    rest = F.regexp_extract(bare, "^https?://[^/]+(.*)$", 1)
    target = F.regexp_extract(href, "^([^?#]*)", 1)
    tail = F.substring(href, F.length(target) + 1, F.length(href))
    path = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_replace(F.when(rest == "", "/").otherwise(rest), "[^/]*$", ""), target))
    steps = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def walk(done, x):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.array_append(done, x))

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    folder = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    joined = F.concat(base_url(base), F.lit("/"), F.array_join(walked, "/"), folder, tail)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href == "", base).when(href.startswith("#"), F.concat(page, href)).when(href.startswith("?"), F.concat(bare, href)).otherwise(joined)
    )


def unescape(c: Column) -> Column:
    """The signs that ``xhtml_escape`` and usual markup escape."""
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def plain_text(body: Column) -> Column:
    """The paragraphs of a chapter body, unescaped, with a blank line between."""
    return F.array_join(F.transform(F.regexp_extract_all(body, F.lit("(?s)<p>(.*?)</p>"), 1), unescape), "\n\n")


def cache_name(ident: Column, n: Column) -> Column:
    """The name of a captured chapter page."""
    return F.concat(ident, F.lit("_"), n.cast("string"), F.lit(".html"))


def timestamp_text(ts: Column) -> Column:
    """A point in time as ISO 8601 in UTC, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def site_and_id(c: Column) -> Column:
    """struct(site, id) of SITE:ID, cut at the first colon; text without a colon is an error."""
    at = F.instr(c, ":")
    wrong = F.raise_error(F.concat(F.lit("not SITE:ID: "), c)).cast("string")
    return F.struct(F.when(at == 0, wrong).otherwise(F.substring(c, F.lit(1), at - 1)).alias("site"), F.substring(c, at + 1, F.length(c)).alias("id"))


def progress_line(n: Column, total: Column, title: Column, chars: int = 50) -> Column:
    """``[ 12%] 3/25 title``, with the first characters of the title."""
    percent = F.floor(n * 100 / total).cast("int")
    return F.concat(F.lit("["), F.lpad(percent.cast("string"), 3, " "), F.lit("%] "), n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" "), F.substring(title, 1, chars))


def truthy(c: Column) -> Column:
    """Whether a setting says yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(False))


def vector_of_bytes(blob: Column) -> Column:
    """array<float> of little-endian 32-bit floats; trailing bytes that make no float are left out."""
    word = lambda i: F.conv(F.array_join(F.transform(F.sequence(F.lit(4), F.lit(1), F.lit(-1)), lambda j: F.hex(F.substring(blob, i * 4 + j, F.lit(1)))), ""), 16, 10).cast("long")

    def value(bits):
        sign = F.when(F.shiftright(bits, 31).bitwiseAND(F.lit(1).cast("long")) == 1, -1.0).otherwise(1.0)
        power = F.shiftright(bits, 23).bitwiseAND(F.lit(255).cast("long")).cast("int")
        part = bits.bitwiseAND(F.lit(0x7FFFFF).cast("long")).cast("double")
        usual = sign * (1 + part / float(1 << 23)) * F.pow(F.lit(2.0), power - 127)
        return F.when(power == 0, sign * part * 2.0**-149).when(power == 255, F.when(part == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(usual).cast("float")

    n = F.floor(F.length(blob) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.array(word(i)), value)[0]))


def literal_pattern(needle: str, ignore_case: bool = True) -> str:
    """A pattern that finds the needle itself; where case is ignored, also beyond ASCII."""
    return ("(?iu)" if ignore_case else "") + "".join("\\" + c if not c.isalnum() and c != " " else c for c in needle)


def xhtml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def split_list(c: Column) -> Column:
    """Comma-joined text as an array; empties are kept, null and '' give no elements."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x)))


def join_list(c: Column) -> Column:
    return F.nullif(F.array_join(c, ", "), F.lit(""))


def excerpt(c: Column, chars: int = 600) -> Column:
    """Null for null or empty; long bodies are cut, right-trimmed and get an ellipsis."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, chars), r"\s+$", ""), F.lit("…"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string")).when(F.length(c) <= chars, c).otherwise(cut)


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02dm%02ds", F.floor(s / 60).cast("bigint"), s % 60)


def ascii_fold(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def like_ascii(c: Column, needle: str) -> Column:
    """Substring pattern match that ignores the case of A-Z only; % and _ stay wildcards."""
    return ascii_fold(c).like(f"%{needle.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))}%")


#: Shape of the gaps' distribution, and tries of a draw (one in fifty is rejected).
GAP_SHAPE, DRAWS = 2.5, 24


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both left out, that the parts alone decide: 52 bits of their digest as text."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def gamma(shape: float, seed: Column, key: Column, n: Column) -> Column:
    """A gamma draw of the shape (1 or more) and scale 1 for draw ``n`` of ``key``: the same wherever and how often it
    is made. By squeezing cubes of normals (Marsaglia and Tsang), each try from its own counter."""
    d = shape - 1.0 / 3.0
    c = 1.0 / (9.0 * d) ** 0.5

    def one(t):
        u = [uniform(seed, key, n, t, F.lit(i)) for i in range(3)]
        z = F.sqrt(-2.0 * F.log(u[0])) * F.cos(2.0 * math.pi * u[1])
        v = F.pow(1.0 + c * z, F.lit(3.0))
        fine = (v > 0) & (F.log(u[2]) < 0.5 * z * z + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        return F.when(fine, d * v)

    tries = F.aggregate(F.sequence(F.lit(0), F.lit(DRAWS - 1)), F.lit(None).cast("double"), lambda got, t: F.when(got.isNotNull(), got).otherwise(one(t)))
    return F.coalesce(tries, F.lit(d))


def gap(mean: Column, seed: Column, key: Column, n: Column) -> Column:
    """The pause before request ``n`` of a site: a gamma draw around ``mean``, clamped; none where the mean is not positive."""
    drawn = gamma(GAP_SHAPE, seed, key, n) * mean / GAP_SHAPE
    return F.when(mean > 0, clamp_gap(drawn, mean)).otherwise(0.0)


def clamp_gap(draw: Column, mean: Column) -> Column:
    return F.when(mean <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(draw, mean * 0.2), mean * 3.0))


def label_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABEL_ORDER]), c).cast("int")


def looks_like_challenge(html: Column, tokens: list[str], phrases: list[str]) -> Column:
    """Machine tokens anywhere, or phrases inside the first title only; case is ignored."""
    low = F.lower(html)
    title = F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1)
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(low, F.lit(t))
    for p in phrases:
        out = out | F.contains(title, F.lit(p))
    return F.coalesce(out, F.lit(False))


def safe_link(rel: Column, style: Column, hidden: Column, aria_hidden: Column) -> Column:
    """False for links a reader does not see or is told not to follow."""
    flat = F.lower(F.replace(F.coalesce(style, F.lit("")), F.lit(" "), F.lit("")))
    nofollow = F.array_contains(F.split(F.lower(F.coalesce(rel, F.lit(""))), r"\s+"), "nofollow")
    unseen = F.contains(flat, F.lit("display:none")) | F.contains(flat, F.lit("visibility:hidden")) | flat.rlike(r"opacity:0(\.0+)?(;|$)")
    return ~(nofollow | unseen | F.coalesce(hidden, F.lit(False)) | (F.lower(F.trim(F.coalesce(aria_hidden, F.lit("")))) == "true"))


def snippets(text: Column, needle: str, context: int, ignore_case: bool = True) -> Column:
    """Non-overlapping literal matches as array<struct<k, snippet>>.

    A match is at least as long as the needle, so a few pieces around it hold all its context;
    the work is linear in the number of matches."""
    pattern = literal_pattern(needle, ignore_case)
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    reach = -(-context // max(1, len(needle)))
    heads = F.zip_with(F.array_prepend(hits, ""), parts, lambda h, p: F.concat(h, p))
    tails = F.zip_with(parts, F.array_append(hits, ""), lambda p, h: F.concat(p, h))

    def cut(before, after):
        def one(hit, k):
            left = F.array_join(F.slice(before, F.greatest(k - reach, F.lit(0)) + 1, F.least(k + 1, F.lit(reach + 1))), "")
            right = F.array_join(F.slice(after, k + 2, F.lit(reach + 1)), "")
            return F.struct((k + 1).alias("k"), F.concat(F.right(left, F.lit(context)), hit, F.left(right, F.lit(context))).alias("snippet"))

        return one

    # bound as lambda variables, the pieces are found once and not once per match
    found = F.transform(F.array(F.struct(heads.alias("a"), tails.alias("b"), hits.alias("h"))), lambda x: F.transform(x["h"], cut(x["a"], x["b"])))[0]
    return F.when(F.size(hits) > 0, found)
