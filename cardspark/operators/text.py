"""Text rules as column expressions (T1 to T26). Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import HAN, SPACE, SPACE_CHARACTERS, SPACES

CUT_NOTE = "\n\n[内容过长，已截断]"
GAP_NOTE = "\n[…素材中段已省略…]\n"


def js_trim(c: Column) -> Column:
    """Trims all Unicode white space and the byte order mark."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def truncate_material(c: Column, limit: int = 5 * 2**20) -> Column:
    """Texts of more UTF-8 bytes than the limit keep that many characters, and a note."""
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit(CUT_NOTE)))


def truncate_head_tail(c: Column, limit: int) -> Column:
    """Longer texts keep their first and last halves of the limit."""
    half = limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, half), F.lit(GAP_NOTE), F.right(c, F.lit(half))))


def escape_envelope(c: Column) -> Column:
    """A closing material tag inside a text is made harmless."""
    return F.regexp_replace(c, rf"(?i)<{SPACE}*/{SPACE}*material{SPACE}*>", r"<\\/material>")


def escape_attribute(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, r'[<>"]', ""))


def strip_html(c: Column) -> Column:
    """T4: scripts and styles go; the article or main element stays if there is one; tags become spaces; runs of white space newlines."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    body = F.regexp_extract(c, r"(?is)<(?:article|main)[^>]*>(.*)</(?:article|main)>", 1)
    c = F.when(c.rlike(r"(?is)<(?:article|main)[^>]*>.*</(?:article|main)>"), body).otherwise(c)
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return js_trim(F.regexp_replace(c, rf"{SPACE}{{2,}}", "\n"))


SITE_CHARS, TITLE_CHARS = 80, 120  # of a meta element's content and of a title that may name a site; longer ones are passed over


def _attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf"""(?i)\s{name}=["']([^"']*)["']""", 1)


def site_name(html: Column, url: Column) -> Column:
    """T5: og:site_name, application-name, first part of the title, or the host's first label.

    Attributes of a meta element come in any order; contents and titles over their limits are passed over for the next source.
    """
    some = lambda x: F.nullif(js_trim(x), F.lit(""))
    metas = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)),
        lambda m: F.struct(F.lower(_attribute(m, "property")).alias("property"), F.lower(_attribute(m, "name")).alias("name"), _attribute(m, "content").alias("content")),
    )
    metas = F.filter(metas, lambda m: F.length(m["content"]).between(1, SITE_CHARS))
    named = lambda key, value: some(F.get(F.filter(metas, lambda m: m[key] == value), F.lit(0))["content"])
    title = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]+)</title>", 1)
    first = some(F.split(some(F.when(F.length(title) <= TITLE_CHARS, title)), r"\s*[-|–—·]\s*")[0])
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1), "^www\\.", "")
    return F.coalesce(named("property", "og:site_name"), named("name", "application-name"), F.when(F.length(first) > 1, F.substring(first, 1, 60)), F.substring(F.split(host, r"\.")[0], 1, 40))


NUMBERS = "0-9０-９零一二三四五六七八九十百千万两"


def parse_rules(text: str) -> list[tuple[str, str]]:
    """Correction rules, `wrong => right` a line; blank lines, # lines and lines without a left side are skipped."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=>" in line:
            left, right = (x.strip() for x in line.split("=>", 1))
            if left:
                out.append((left, right))
    return out


def apply_corrections(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules in order; plain text is replaced everywhere; one {num} on the left stands for a run of digits or Chinese numerals."""
    quote = lambda s: "".join(f"\\x{{{ord(x):X}}}" for x in s)
    for wrong, right in rules:
        n = wrong.count("{num}")
        if n > 1 or (n == 0 and "{num}" in right):
            continue
        if n:
            a, b = wrong.split("{num}")
            new = right.replace("\\", r"\\").replace("$", r"\$").replace("{num}", "$1")
            c = F.regexp_replace(c, f"{quote(a)}([{NUMBERS}]+){quote(b)}", new)
        else:
            c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def note_folder(path: Column) -> Column:
    """The path's top folder, empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def _bigrams(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"({HAN}{{2,}})"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))
    return F.flatten(F.transform(runs, pairs))


def zh_bigrams(c: Column) -> Column:
    """Neighbouring characters of each CJK run, joined by spaces."""
    return F.array_join(_bigrams(c), " ")


def inject_bigrams(c: Column) -> Column:
    pairs = zh_bigrams(c)
    return F.when(pairs == "", c).otherwise(F.concat_ws(" ", c, pairs))


def tokenize_query(c: Column) -> Column:
    """Distinct lower-case words [a-z0-9]{3,} and CJK bigrams, in order of kind and place."""
    low = F.lower(c)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("([a-z0-9]{3,})"), 1), _bigrams(low)))


def strip_think(c: Column) -> Column:
    """Closed think blocks go."""
    return F.regexp_replace(c, r"(?is)<think[^>]*>.*?</think>", "")


def open_think(c: Column) -> Column:
    return strip_think(c).rlike(r"(?i)<think[^>]*>")


def passage_text(title: Column, summary: Column, details: Column, limit: int = 1800) -> Column:
    """Parts that are not empty, joined by 。"""
    return F.substring(F.array_join(F.filter(F.array(title, summary, details), lambda x: x != ""), "。"), 1, limit)


def content_hash(title: Column, summary: Column, details: Column, tags: Column) -> Column:
    """SHA-1 of the parts, parted by U+0001."""
    return F.sha1(F.concat_ws("\x01", title, summary, details, F.array_join(tags, ",")))


def key_sentences(c: Column) -> Column:
    """The first two sentences of 15 characters or more; without any, the first 80 characters."""
    parts = F.filter(F.transform(F.split(c, rf"(?<=[。！？.!?]){SPACE}*"), js_trim), lambda x: F.length(x) >= 15)
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), "")).otherwise(F.concat(F.substring(c, 1, 80), F.lit("…")))


def detect_locale(c: Column) -> Column:
    """Of the last 500 characters, zh-CN if three tenths of the letters are Chinese or letters are fewer than five."""
    tail = F.right(c, F.lit(500))
    zh, latin = F.regexp_count(tail, F.lit(HAN)), F.regexp_count(tail, F.lit("[a-zA-Z]"))
    return F.when((zh + latin < 5) | (zh / F.greatest(F.lit(1), zh + latin) >= 0.3), "zh-CN").otherwise("en-US")


def blocked_host(host: Column) -> Column:
    """Hosts that a fetcher must not reach: local names, private and special addresses."""
    h = F.regexp_replace(F.lower(js_trim(F.coalesce(host, F.lit("")))), r"^\[|\]\z", "")
    mapped = F.regexp_extract(h, r"^::ffff:([0-9.]+)\z", 1)
    v4 = F.when(mapped != "", mapped).otherwise(h)
    o = F.split(v4, r"\.")
    a, b = o[0].cast("int"), o[1].cast("int")
    private = (a.isin(0, 10, 127)) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 100) & b.between(64, 127))
    is_v4 = v4.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    name = h.isin("", "localhost") | h.rlike(r"\.(localhost|local|internal)\z")
    v6 = h.contains(":") & (mapped == "") & (h.isin("::1", "::") | h.rlike("^(fc|fd|fe80)"))
    return name | F.when(is_v4, private).otherwise(v6)


def client_ip(trusted: Column, forwarded: Column) -> Column:
    """The trusted header, else the last hop of the forwarded list, else unknown."""
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), js_trim), lambda x: x != "")
    return F.coalesce(F.nullif(js_trim(trusted), F.lit("")), F.try_element_at(hops, F.lit(-1)), F.lit("unknown"))


KEY_LETTERS = "ABCDEFGHJKMNPQRSTVWXYZ23456789"


def mask_key(key: Column) -> Column:
    """Keys of 32 characters show the first eight and last four."""
    return F.when(F.length(key) == 32, F.concat(F.substring(key, 1, 8), F.lit("****"), F.right(key, F.lit(4)))).otherwise(key)


def valid_key(key: Column, prefix: str) -> Column:
    return (F.length(key) == 32) & key.rlike(f"^{prefix}[{KEY_LETTERS}]+\\z")


def claim_of(status: Column, expires: Column, now: Column) -> Column:
    """What a licence gives at a time."""
    return F.when(expires <= now, "expired").when(status == "active", "active").when(status == "expired", "expired").otherwise("none")


def company_hash(name: Column) -> Column:
    """SHA-256 of the trimmed lower-case name, null when blank."""
    n = F.lower(js_trim(name))
    return F.when(n != "", F.sha2(n, 256))


def safe_filename(title: Column, default: str = "卡片") -> Column:
    """A base name without characters that file systems or notes forbid, of 80 characters at most."""
    c = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|#^\[\]]', " ")
    c = F.regexp_replace(c, f"{SPACE}+", " ")
    c = js_trim(F.substring(js_trim(F.regexp_replace(c, rf"^[.{SPACES}]+", "")), 1, 80))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def display_name(ref: Column, default: str = "") -> Column:
    """The reference up to its last ` (`."""
    head = F.regexp_extract(ref, r"(?s)^(.*) \(", 1)
    return F.when(F.instr(ref, " (") > 0, head).otherwise(F.coalesce(ref, F.lit(default)))


def text_material_ref(c: Column) -> Column:
    """The first 50 characters of a pasted text, newlines as spaces; null under ten characters."""
    return F.when(F.length(js_trim(c)) >= 10, F.regexp_replace(F.substring(c, 1, 50), "\n", " "))


def fetch_route(static: Column, rendered: Column, enough: int = 500, least: int = 50) -> Column:
    """V3: a page's static text if it is long enough, else its rendered text, else too short."""
    return F.when(F.length(F.coalesce(static, F.lit(""))) >= enough, "static").when(rendered.isNull(), "render").when(F.length(rendered) < least, "too_short").otherwise("rendered")
