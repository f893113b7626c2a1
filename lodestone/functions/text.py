"""Cleaning and normalising expressions (Column -> Column).

All of them are built-in expressions, so they run inside generated code and
add no stage of their own to the job that uses them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.rules import fixed as R

CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sanitize_query(c: Column, cap: int | None = R.MAX_QUERY_LENGTH) -> Column:
    """Trim, cap (for a request; a log is read whole with None), drop control characters, collapse spaces, drop brackets."""
    c = strip(F.coalesce(c, F.lit("")))
    c = c if cap is None else F.substring(c, 1, cap)
    c = F.regexp_replace(F.regexp_replace(c, CONTROL, ""), r"\s+", " ")
    return F.regexp_replace(c, r"[<>{}|\[\]\\^`]", "")


def sanitize_filter_value(c: Column) -> Column:
    c = F.substring(strip(F.coalesce(c, F.lit(""))), 1, R.MAX_FILTER_LENGTH)
    return F.regexp_replace(c, r"""[&|!=<>:;\[\]{}()'"\\]""", "")


def sanitize_url(c: Column) -> Column:
    c = F.regexp_replace(F.substring(strip(F.coalesce(c, F.lit(""))), 1, R.MAX_URL_LENGTH), CONTROL, "")
    return F.when(c.rlike(r"^https?://"), c).otherwise("")


def sanitize_string(c: Column, cap: int = R.MAX_STRING_LENGTH) -> Column:
    return F.regexp_replace(F.substring(strip(F.coalesce(c, F.lit(""))), 1, cap), CONTROL, "")


def sanitize_int(c: Column, default: int = 0, lo: int | None = None, hi: int | None = None) -> Column:
    n = c.try_cast("bigint")
    if lo is not None:
        n = F.when(n < lo, F.lit(lo)).otherwise(n)
    if hi is not None:
        n = F.when(n > hi, F.lit(hi)).otherwise(n)
    return F.coalesce(n, F.lit(default).cast("bigint"))


def validate_page(c: Column, default: int = 1, cap: int = R.MAX_PAGE) -> Column:
    n = c.try_cast("bigint")
    return F.when(n.isNull() | (n < 1), F.lit(default)).otherwise(F.least(n, F.lit(cap))).cast("bigint")


def validate_per_page(c: Column, default: int = R.DEFAULT_PER_PAGE) -> Column:
    return validate_page(c, default, R.MAX_PER_PAGE)


def validate_choice(c: Column, allowed: list[str], default: str = "", lower: bool = True) -> Column:
    v = strip(F.lower(c) if lower else c)
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters."""
    return F.initcap(F.lower(c))


def normalize_city(c: Column, supported: list[str] | None = None, default: str = R.DEFAULT_CITY) -> Column:
    v = strip(F.coalesce(c, F.lit("")))
    alias = F.create_map(*[F.lit(x) for kv in R.CITY_ALIASES.items() for x in kv])
    city = F.coalesce(F.try_element_at(alias, F.lower(v)), title_case(v))
    return F.when(city.isin(R.SUPPORTED_CITIES if supported is None else supported), city).otherwise(default)


def normalize_query(c: Column, cap: int | None = None) -> Column:
    """Lower case, every non-alphanumeric to a space, collapsed; ``cap`` cuts a request."""
    v = squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", " "))
    return v if cap is None else F.substring(v, 1, cap)


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.md5(c), 1, n)


def trending_hash(c: Column) -> Column:
    return short_hash(strip(F.lower(c)), 12)


def store_hash(c: Column) -> Column:
    return short_hash(normalize_query(c), 16)


def result_cache_key(session: Column, query: Column) -> Column:
    sess = F.coalesce(blank_null(session.cast("string")), F.lit("nosession"))
    return F.md5(F.concat_ws("|", F.lit("final"), sess, F.lower(strip(query))))


def joined_cache_key(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.md5(F.concat_ws(":", *cols)))


def question_slug(c: Column) -> Column:
    v = strip(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))
    return F.concat(F.lit("questions:"), F.regexp_replace(v, r"\s+", "_"))


def raw_tokens(c: Column) -> Column:
    """Lower-case words: punctuation and hyphens become separators."""
    v = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.split(v, r"\s+")


def token_list(c: Column, stop: list[str]) -> Column:
    """Match tokens in order, repeats kept."""
    return F.filter(raw_tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(stop))


def match_tokens(c: Column) -> Column:
    return F.array_distinct(token_list(c, R.MATCH_STOPWORDS))


def signal_tokens(c: Column) -> Column:
    return F.array_distinct(token_list(c, R.SIGNAL_STOPWORDS))


def words(c: Column) -> Column:
    """Lower-case words of a query: punctuation dropped, order and repeats kept."""
    v = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s'-]", " ")
    return F.filter(F.split(v, r"\s+"), lambda t: t != "")


def truncate_query(c: Column, max_words: int = R.MAX_EMBED_WORDS) -> Column:
    """Drop filler phrases, keep at most ``max_words`` words."""
    v = reduce(lambda acc, p: F.regexp_replace(acc, "(?i)" + p, " "), R.FILLER_PATTERNS, c)
    v = F.array_join(F.slice(F.split(squeeze(v), " "), 1, max_words), " ")
    return F.coalesce(blank_null(v), F.substring(c, 1, 200))


def parse_rank(c: Column) -> Column:
    d = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d).try_cast("bigint"), F.lit(0).cast("bigint"))


def normalize_pos(c: Column) -> Column:
    """First element of a list or list-like string; places become proper nouns."""
    first = F.regexp_extract(c, r"""^\[\s*['"]([^'"]*)['"]""", 1)
    v = F.lower(F.when(c.isNull(), F.lit("unknown"))
                .when(c.rlike(r"^\[\s*\]"), F.lit("unknown"))
                .when(c.startswith("[") & (first != ""), first).otherwise(c))
    place = v.isin(R.LOCATION_CATEGORIES) | v.contains("city") | v.contains("state")
    return F.when(place, F.lit("proper_noun")).otherwise(v)


def ngram_type(term: Column, entity_type: Column | None = None) -> Column:
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    # a term without other white space than single spaces inside needs no pattern
    rough = reduce(lambda a, b: a | b, [term.contains(w) for w in ("  ", "\t", "\n", "\x0b", "\f", "\r")]) | term.startswith(" ") | term.endswith(" ")
    n = F.when(rough, spaces(squeeze(term))).otherwise(spaces(term)) + 1
    names = F.create_map(*[F.lit(x) for kv in R.NGRAM_NAMES.items() for x in kv])
    by_count = F.coalesce(F.try_element_at(names, n), F.lit("ngram"))
    if entity_type is None:
        return by_count
    return F.when(entity_type.isin([*R.NGRAM_NAMES.values(), "ngram"]), entity_type).otherwise(by_count)


def is_location(c: Column) -> Column:
    v = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("_"))
    return (v.isin(R.LOCATION_CATEGORIES) | v.contains("city") | v.contains("state")
            | v.contains("continent"))


def is_city(c: Column) -> Column:
    v = F.lower(F.coalesce(c, F.lit("")))
    return v.contains("city") | v.contains("county")


def is_state(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).contains("state")


def state_variants(c: Column) -> Column:
    """Title-cased name plus the abbreviation or full name it stands for."""
    v = strip(F.lower(c))
    to_abbrev = F.create_map(*[F.lit(x) for kv in R.US_STATES.items() for x in kv])
    to_name = F.create_map(*[F.lit(x) for k, a in R.US_STATES.items() for x in (a.lower(), k)])
    alts = F.array(title_case(c), F.try_element_at(to_abbrev, v),
                   title_case(F.try_element_at(to_name, v)))
    return F.array_sort(F.array_distinct(F.array_compact(alts)))


def temporal_expressions(c: Column) -> Column:
    """Years, decades, ranges, centuries, relative phrases and eras of a text."""
    p = R.TEMPORAL_PATTERNS

    def found(col: Column, key: str, group: int) -> Column:
        return F.regexp_extract_all(col, F.lit(p[key]), F.lit(group))

    low = F.lower(c)
    starts, ends = found(c, "year_range", 1), found(c, "year_range", 2)
    decades = F.transform(found(c, "decade", 1), lambda y: F.concat(y, F.lit("s")))
    used = F.concat(starts, ends)
    years = F.filter(found(c, "year", 1), lambda y: ~F.array_contains(used, y)
                     & ~F.array_contains(decades, F.concat(y, F.lit("s"))))
    return F.struct(
        years.cast("array<int>").alias("years"),
        decades.alias("decades"),
        F.zip_with(starts, ends, lambda a, b: F.concat(a, F.lit(","), b)).alias("ranges"),
        found(c, "century", 1).cast("array<int>").alias("centuries"),
        found(low, "relative", 0).alias("relative"),
        found(low, "era", 0).alias("eras"),
    )


def has_temporal_intent(t: Column) -> Column:
    return reduce(lambda a, b: a | b,
                  [F.size(t[k]) > 0 for k in
                   ("years", "decades", "ranges", "centuries", "relative", "eras")])


def format_date(c: Column) -> Column:
    """ISO date or date-time to ``Mon dd, yyyy``; anything else unchanged."""
    day = F.when(c.contains("T"), F.substring_index(c, "T", 1)) \
        .when(c.contains("-") & (F.length(c) >= 10), F.substring(c, 1, 10))
    return F.coalesce(F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "MMM dd, yyyy"),
                      c, F.lit(""))


def time_ago(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    days = F.floor(s / 86400)
    rest = s - days * 86400

    def label(n: Column, unit: str) -> Column:
        return F.concat(F.floor(n).cast("string"), F.lit(unit))

    return (F.when(ts.isNull(), F.lit("Today"))
            .when(days > 30, label(days / 30, "mo ago"))
            .when(days > 0, label(days, "d ago"))
            .when(rest >= 3600, label(rest / 3600, "h ago"))
            .when(rest >= 60, label(rest / 60, "m ago"))
            .otherwise(F.lit("Just now")))


def parse_user_agent(c: Column) -> Column:
    """Browser, device, system and bot flags from marker substrings."""
    ua = F.lower(c)

    def has(*marks: str) -> Column:
        return reduce(lambda a, b: a | b, [ua.contains(m) for m in marks])

    slate = has("tablet", "ipad")
    handheld = has("mobile") | (has("android") & ~has("tablet"))
    bot = has(*R.BOT_MARKERS)
    browser = (F.when(has("edg/"), "Edge")
               .when(has("chrome/") & ~has("chromium/"), "Chrome")
               .when(has("firefox/"), "Firefox")
               .when(has("safari/") & ~has("chrome/"), "Safari")
               .when(has("opera/", "opr/"), "Opera")
               .when(has("msie", "trident/"), "Internet Explorer").otherwise("Unknown"))
    os_name = (F.when(has("windows"), "Windows")
               .when(has("mac os x", "macintosh"), "macOS")
               .when(has("iphone", "ipad"), "iOS")
               .when(has("android"), "Android")
               .when(has("linux"), "Linux").otherwise("Unknown"))
    version = (F.when(has("windows nt 10"), "10").when(has("windows nt 6.3"), "8.1")
               .when(has("windows nt 6.1"), "7").otherwise(""))
    device = (F.when(bot, "Bot").when(slate, "Tablet").when(handheld, "Mobile").otherwise("Desktop"))
    return F.struct(browser.alias("browser"), device.alias("device_type"), os_name.alias("os"),
                    version.alias("os_version"), bot.alias("is_bot"),
                    (handheld & ~slate).alias("is_mobile"), slate.alias("is_tablet"),
                    (device == "Desktop").alias("is_pc"))


def client_ip(connecting: Column, forwarded: Column, real: Column, remote: Column) -> Column:
    return F.coalesce(strip(blank_null(connecting)),
                      strip(F.split(blank_null(forwarded), ",")[0]),
                      strip(blank_null(real)), remote, F.lit(""))


def is_private_ip(c: Column) -> Column:
    v = F.coalesce(c, F.lit(""))
    alt = "|".join(p.replace(".", r"\.") for p in R.PRIVATE_IP_PREFIXES)
    return (v == "") | (F.lower(v) == "localhost") | v.rlike(f"^({alt})")


def extract_coords(lat: Column, lng: Column, pair: Column, text: Column) -> Column:
    """struct(lat, lng) from flat fields, a two-element array or ``lat,lng`` text.

    A source counts only when both its parts are present and not zero.
    """
    def use(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        return F.when((x != 0) & (y != 0), F.struct(x.alias("lat"), y.alias("lng")))

    parts = F.split(text, ",")
    got = F.coalesce(use(lat, lng),
                     F.when(F.size(pair) == 2, use(pair[0], pair[1])),
                     F.when(F.size(parts) == 2, use(strip(parts[0]), strip(F.get(parts, F.lit(1))))))
    return F.when(got["lat"].between(-90, 90) & got["lng"].between(-180, 180), got)


def initials(c: Column, n_words: int = 2) -> Column:
    w = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    return F.upper(F.array_join(F.transform(F.slice(w, 1, n_words), lambda t: F.substring(t, 1, 1)), ""))


def excerpt(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def has_images(*arrays: Column) -> Column:
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.exists(a, lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(False))
                   for a in arrays])


def classify_web_handle(c: Column) -> Column:
    v = F.lower(strip(F.coalesce(c, F.lit(""))))
    hit = reduce(lambda a, b: a | b, [v.rlike(p) for p in R.WEB_HANDLE_PATTERNS])
    return F.when(v == "", F.lit("")).when(hit, F.lit("match")).otherwise(F.lit("no match"))


def base_term(key: Column) -> Column:
    """``term:<x>:<category>`` -> ``<x>``; other keys unchanged."""
    return F.when(key.startswith("term:"), F.split(key, ":")[1]).otherwise(key)
