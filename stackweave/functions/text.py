"""Column functions on package names, texts, addresses and numbers: built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def starts_with_any(c: Column, stems: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in stems:
        out = out | c.startswith(s)
    return out


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def normalize_name(c: Column) -> Column:
    """STR-01: no outer blanks and quotes, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")))


def requirement_name(c: Column) -> Column:
    """STR-02: the name of a requirement, without marker, extras and version."""
    name = F.substring_index(F.substring_index(c, ";", 1), "[", 1)
    return normalize_name(F.element_at(F.split(F.trim(name), "[<>=!~ ]"), 1))


def purl_name(c: Column) -> Column:
    """STR-03: the package of a purl, decoded and without version, qualifiers and fragment."""
    body = F.substring_index(F.substring_index(F.regexp_replace(c, "^pkg:[^/]*/", ""), "?", 1), "#", 1)
    plain = F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    return normalize_name(F.regexp_replace(plain, "(?<=.)@[^@/]*$", ""))


UNSCOPED_BLOCKED = ("modal", "sandbox", "containers")


def sbom_candidates(name: Column, purl: Column) -> Column:
    """STR-03: ordered distinct names to try: the purl's, its last part, the package's own, and its last part."""

    def with_base(c: Column) -> list[Column]:
        base = F.substring_index(c, "/", -1)
        return [c, F.when(F.contains(c, F.lit("/")) & ~base.isin(*UNSCOPED_BLOCKED), base)]

    tried = F.array(*with_base(F.when(purl.startswith("pkg:"), purl_name(purl))), *with_base(normalize_name(name)))
    return F.array_distinct(F.filter(tried, lambda x: x.isNotNull() & (x != "")))


def scope_token(scope: Column) -> Column:
    return F.regexp_replace(F.lower(scope), "^(.+?)(hq|inc|labs|dev)$", "$1")


def family_id(c: Column, generic: Sequence[str] = W.GENERIC_BASES) -> Column:
    """STR-04: the base of a scoped package unless that is generic, else its scope; the first part of another's name."""
    name = F.lower(c)
    scope, base = F.substring_index(F.substring(name, 2, 1 << 30), "/", 1), F.substring_index(name, "/", -1)
    token = F.element_at(F.split(base, "[-_.]"), 1)
    scoped = F.when((F.length(token) >= 3) & ~token.isin(*generic), token).otherwise(scope_token(scope))
    return F.when(name.startswith("@") & F.contains(name, F.lit("/")), scoped).otherwise(F.element_at(F.split(name, "[-_.]"), 1))


def package_prefix(c: Column) -> Column:
    """STR-05: the scope with its slash, else what comes before the first -, else before the first _, else before the first dot."""
    out = F.when(c.startswith("@") & F.contains(c, F.lit("/")), F.concat(F.substring_index(c, "/", 1), F.lit("/")))
    for mark in "-_.":
        out = out.when(F.contains(c, F.lit(mark)), F.substring_index(c, mark, 1))
    return out.otherwise(c)


def ai_affinity(c: Column, tokens: Sequence[str] = W.AI_TOKENS, stems: Sequence[str] = W.AI_STEMS) -> Column:
    """STR-06: one of the name's parts is an AI word or begins with an AI stem."""
    return F.exists(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t.isin(*tokens) | starts_with_any(t, stems))


def mentions(text: Column, alias: Column, head: int = 50_000) -> Column:
    """STR-07: the alias stands in the text's head with no letter or digit on either side."""
    return F.regexp_like(F.lower(F.substring(text, 1, head)), F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(alias), F.lit("\\E(?![a-z0-9])")))


def usable_alias(alias: Column, stop: Sequence[str]) -> Column:
    return (F.length(alias) >= 4) & ~F.lower(alias).isin(*stop)


def keyword_sources(haystacks: dict[str, Column], keywords: Sequence[str]) -> Column:
    """STR-08: map of each keyword that occurs to the sources it occurs in."""
    low = {name: F.lower(F.coalesce(c, F.lit(""))) for name, c in haystacks.items()}
    pairs = [F.struct(F.lit(k).alias("key"), F.filter(F.array(*[F.when(F.contains(c, F.lit(k)), F.lit(n)) for n, c in low.items()]), lambda x: x.isNotNull()).alias("value")) for k in keywords]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.size(p["value"]) > 0))


def educational(text: Column, strong: Sequence[str], weak: Sequence[str], head: int = 4000) -> Column:
    """STR-09: any strong word, or two weak ones, in the text's head."""
    low = F.lower(F.substring(text, 1, head))
    count = sum((F.contains(low, F.lit(w)).cast("int") for w in weak), F.lit(0))
    return contains_any(low, strong) | (count >= 2)


def product_docs(text: Column) -> Column:
    """STR-10."""
    return contains_any(F.lower(text), ("installation", "quickstart", "usage"))


def slugify(c: Column) -> Column:
    """STR-11."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def display_name(c: Column) -> Column:
    """STR-11: words in title case."""
    return F.initcap(F.trim(F.regexp_replace(c, "[-_./@]+", " ")))


def domain(c: Column) -> Column:
    """STR-12: host in lower case, without www. and a last dot."""
    host = F.substring_index(F.substring_index(F.substring_index(F.regexp_replace(F.lower(F.trim(c)), "^[a-z][a-z0-9+.-]*://", ""), "/", 1), "?", 1), "#", 1)
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, ":", 1), "^www\\.", ""), "\\.+$", "")


def domains_in(text: Column) -> Column:
    """STR-12: distinct domains of the addresses in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("https?://[^\\s)\\]>\"'<]+"), 0), domain)))


def in_domain(host: Column, of: Column) -> Column:
    return (host == of) | F.endswith(host, F.concat(F.lit("."), of))


def format_int(c: Column) -> Column:
    """STR-13."""
    return F.format_number(c.cast("bigint"), 0)


def format_percent(c: Column) -> Column:
    """STR-13: a share as per cent with one place."""
    return F.format_string("%.1f%%", c.cast("double") * 100)


def segment_key(c: Column) -> Column:
    """STR-14: the form in which a segment's name is compared."""
    return F.translate(F.lower(F.trim(c)), "-/ ", "___")


def noisy_package(c: Column) -> Column:
    return F.lower(c).isin(*W.NOISY_NAMES) | starts_with_any(F.lower(c), W.NOISY_STEMS)


def own_scope(package: Column, full_name: Column) -> Column:
    """The package's scope is its repository's owner, apart from - and _."""
    plain = lambda c: F.translate(F.lower(c), "-_", "")
    scope = F.substring_index(F.substring(package, 2, 1 << 30), "/", 1)
    return F.coalesce(package.startswith("@") & F.contains(package, F.lit("/")) & (plain(scope) == plain(F.substring_index(full_name, "/", 1))), F.lit(False))


def suppressed_package(package: Column, full_name: Column, suppressed: Sequence[str] = ("@rollup/",)) -> Column:
    """FIL-06."""
    return noisy_package(package) | package_prefix(F.lower(package)).isin(*suppressed) | own_scope(package, full_name)


def ignored_in_discovery(package: Column, purl: Column) -> Column:
    """FIL-07."""
    p = F.lower(package)
    return F.coalesce(purl.startswith("pkg:githubactions/"), F.lit(False)) | starts_with_any(p, W.GENERIC_SCOPES) | p.isin(*W.NOISY_NAMES)


def low_signal_family(c: Column) -> Column:
    """FIL-08."""
    return (F.length(c) < 3) | c.isin("js", "ts", "py")


HIGH_SIGNAL = ("llama", "nvidia")
HIGH_SIGNAL_SCOPES = ("@crawlee/",)


def commodity_prefix(prefix: Column, ai_count: Column) -> Column:
    """FIL-09."""
    p = F.lower(prefix)
    return F.when(p.isin(*HIGH_SIGNAL), F.lit(False)).when(p.isin(*W.COMMODITY) | starts_with_any(p, ("@rollup/", "@types/")), F.lit(True)).otherwise((ai_count <= 0) & ~ai_affinity(p))


def ai_prefix(prefix: Column, ai_count: Column) -> Column:
    """FIL-09."""
    p = F.lower(prefix)
    short = ~p.startswith("@") & (F.length(p) < 4)
    return ~short & ~commodity_prefix(p, ai_count) & (p.isin(*HIGH_SIGNAL, *HIGH_SIGNAL_SCOPES) | ai_affinity(p))


def generic_penalty(family: Column) -> Column:
    """MAT-07."""
    f = F.lower(family)
    listed = F.when(f.isin(*W.GENERIC_FAMILIES), 0.65).otherwise(0.0)
    github = F.when(f.startswith("github"), 0.25).otherwise(0.0)
    scope = F.when(starts_with_any(f, W.GENERIC_SCOPES), 0.65).otherwise(0.0)
    return F.least(F.lit(0.85), listed + github + scope)


def evidence_strength(kind: Column) -> Column:
    """CLS-08."""
    return F.when(kind.isin("manifest", "sbom", "import"), "direct").when(kind == "repo_identity", "identity").when(kind == "readme_mention", "fallback").otherwise("unknown")


def evidence_profile(kinds: Column) -> Column:
    """SET-05: what a repository's set of evidence types amounts to."""
    direct = F.arrays_overlap(kinds, F.array(F.lit("manifest"), F.lit("sbom"), F.lit("import")))
    readme, identity = F.array_contains(kinds, "readme_mention"), F.array_contains(kinds, "repo_identity")
    return (
        F.when(F.size(kinds) == 0, "unmapped")
        .when(direct & readme, "mixed_direct_and_fallback")
        .when(direct, "direct_only")
        .when(readme & identity & (F.size(kinds) == 2), "repo_identity_plus_fallback")
        .when(readme & (F.size(kinds) == 1), "readme_only")
        .when(identity & (F.size(kinds) == 1), "repo_identity_only")
        .otherwise("other")
    )
