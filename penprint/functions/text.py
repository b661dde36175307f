"""Text measures as column expressions: no Python function runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint.functions import patterns as P


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, "^(?U)\\s+|(?U)\\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+\\z", "")


def filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Parts between a sentence end and a capital or digit; abbreviations don't end one."""
    return filled(F.split(strip(text), P.SENTENCE_BREAK))


def paragraphs(text: Column) -> Column:
    return filled(F.split(strip(text), P.PARAGRAPH_BREAK))


def split_sentences(text: Column) -> Column:
    """The sentences of each paragraph."""
    return F.transform(paragraphs(text), sentences)


def words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(text, F.lit(P.WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.WORD))


def blank_words(text: Column) -> Column:
    """Runs of anything but white space; not the same as words()."""
    return F.filter(F.split(text, P.BLANK), lambda x: x != "")


def n_blank_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?U)\\S+"))


def shingles(text: Column, n: int = P.SHINGLE_WORDS) -> Column:
    """Distinct n-word windows of lower-case words; fewer words are one shingle, none the empty one."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(found, lambda w: F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(windows(w))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; two empty ones have none in common."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Shingle Jaccard of two texts; a blank text is like nothing."""
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    return F.when(blank(a) | blank(b), F.lit(0.0)).otherwise(jaccard(shingles(a), shingles(b)))


def opener(body: Column) -> Column:
    """Kind of the first line: hi_name, hey_name, name_dash, bare_name or none."""
    name, dash = "[A-Z][\\w'-]*", "\\s*[\u2014\u2013-]"
    kinds = {
        "hi_name": "(?iuU)^hi\\s+[A-Z][\\w'-]*\\b",
        "hey_name": "(?iuU)^(?:hey|hello)\\s+[A-Z][\\w'-]*\\b",
        "name_dash": f"(?U)^{name}{dash}(?:\\s*$|\\s+\\S)",
        "bare_name": f"(?U)^{name},\\s*$",
    }

    def of(first: Column) -> Column:
        out = F.lit("none")
        for kind in reversed(kinds):
            out = F.when(F.rlike(first, F.lit(kinds[kind])), kind).otherwise(out)
        return out

    # What is white space at the end of the first line goes with it, so the rest of the text needs no look.
    return let(strip(F.split_part(F.regexp_replace(body, "\\A(?U)\\s+", ""), F.lit("\n"), F.lit(1))), of)


def last_lines(body: Column) -> Column:
    """The last two filled lines, stripped; empty ones where there are fewer."""
    return F.slice(F.concat(F.array(F.lit(""), F.lit("")), filled(F.split(body, "\n"))), -2, 2)


def signoff(body: Column, tail: Column | None = None) -> Column:
    """The later of the last two filled lines that is a sign-off phrase, else none."""
    cleaned = F.transform(last_lines(body) if tail is None else tail, lambda x: F.lower(strip(F.regexp_replace(x, ",+$", ""))))
    hits = F.filter(cleaned, lambda x: x.isin(P.SIGNOFFS))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("none"))


def name_form(body: Column, tail: Column | None = None) -> Column:
    """Form of the name that the last line is: initial, first_name, full_name or none."""
    bare = F.regexp_replace(strip(F.regexp_replace(F.element_at(last_lines(body) if tail is None else tail, -1), "^[\u2014\u2013-]+", "")), ",+$", "")
    # An upper-case first character, as one that lower-casing changes and upper-casing doesn't.
    capital = lambda x: let(F.substring(x, 1, 1), lambda c: (F.upper(c) == c) & (F.lower(c) != c))

    def of(names: Column) -> Column:
        named = F.size(names).between(1, 3) & F.forall(names, capital)
        one = F.when(F.length(F.get(names, F.lit(0))) <= 2, "initial").otherwise("first_name")
        return F.when(~named, "none").when(F.size(names) == 1, one).otherwise("full_name")

    return let(blank_words(bare), of)


def n_contracted(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.CONTRACTED_FORM))


def n_expanded(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.EXPANDED_FORM))


PUNCTUATION = {"em_dash": P.EM_DASH, "ellipsis": P.ELLIPSIS, "exclamation": "!", "semicolon": ";", "parenthesis": "\\(", "emoji": P.EMOJI}


def n_punctuation(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(PUNCTUATION[kind]))


def n_hedges(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.HEDGE))


def n_questions(found: Column) -> Column:
    """Of sentences, those that end with a question mark."""
    return F.size(F.filter(found, lambda s: F.endswith(s, F.lit("?"))))


def n_imperatives(found: Column) -> Column:
    return F.size(F.filter(found, lambda s: F.rlike(s, F.lit(P.IMPERATIVE))))


def n_bullets(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(P.BULLET_LINE))))


def asks(text: Column) -> Column:
    return F.rlike(text, F.lit(P.ASK))


def ask_placement(text: Column, parts: Column | None = None) -> Column:
    """Index of the first asking sentence over their number, rounded to three places; null without one."""
    every = F.flatten(split_sentences(text) if parts is None else parts)
    asking = lambda s: F.transform(s, lambda x: asks(x) | F.rlike(x, F.lit(P.IMPERATIVE)))
    return let(every, lambda s: F.round((F.nullif(F.array_position(asking(s), True), F.lit(0)) - 1) / F.size(s), 3))


def n_non_ascii(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))


def for_comparison(text: Column) -> Column:
    """Without what mail programs change: redirects around links, their schemes, and soft line breaks."""
    return unwrapped_lines(F.regexp_replace(unwrapped_urls(text), P.URL_SCHEME, ""))


def unwrapped_urls(text: Column) -> Column:
    """Targets of click-tracking links in place of them. Escapes that can't be decoded stay."""
    marked = F.split(F.regexp_replace(text, P.TRACKED_URL, "\x01$1\x02"), "\x01")

    def target(part: Column, i: Column) -> Column:
        link = F.substring_index(part, "\x02", 1)
        plain = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)
        return F.when((i == 0) | ~F.contains(part, F.lit("\x02")), part).otherwise(F.concat(plain, F.substring(part, F.length(link) + 2, F.length(part))))

    return F.array_join(F.transform(marked, target), "")


def unwrapped_lines(text: Column) -> Column:
    """Lines of a paragraph joined by blanks, but for list items."""
    one = lambda p: F.regexp_replace(F.array_join(filled(F.split(p, "\n")), "\n"), f"\\n(?!{P.LIST_ITEM})", " ")
    return F.array_join(F.transform(F.split(text, P.PARAGRAPH_BREAK), one), "\n\n")


def without_quotes(body: Column) -> Column:
    """Cut at the earliest mark of a quoted message."""
    return rstrip(F.regexp_replace(body, P.QUOTED, ""))


def without_signature(body: Column) -> Column:
    """Cut at a signature mark or mobile footer, then drop contact lines from the end, and labels above them."""
    cut = rstrip(F.regexp_replace(F.regexp_replace(body, P.SIGNATURE_MARK, ""), P.MOBILE_FOOTER, ""))

    def kept(lines: Column) -> Column:
        start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("contact"), F.lit(0).alias("dropped"))

        def step(s: Column, line: Column) -> Column:
            x = strip(line)
            contact = F.rlike(x, F.lit(P.CONTACT)) & (n_blank_words(x) <= 8)
            label = s["contact"] & is_label(x)
            drops = ~s["done"] & (x != "") & (s["dropped"] < F.size(lines) - 1) & (contact | label)
            return F.struct((~drops).alias("done"), (s["contact"] | (drops & contact)).alias("contact"), (s["dropped"] + drops.cast("int")).alias("dropped"))

        dropped = F.aggregate(F.reverse(lines), start, step)["dropped"]
        return rstrip(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - dropped), "\n"))

    return let(F.split(cut, "\n"), kept)


def is_label(line: Column) -> Column:
    """Short, without a leading dash or star and without a sentence end."""
    return F.rlike(line, F.lit("(?U)^[^\\-\u2013\u2014*]")) & n_blank_words(line).between(1, 6) & ~F.rlike(line, F.lit("[.!?]$"))


def domains(addresses: Column) -> Column:
    """Distinct lower-case domains in order: what follows the first at sign."""
    with_at = F.filter(addresses, lambda a: F.contains(a, F.lit("@")))
    return F.array_distinct(F.transform(with_at, lambda a: F.lower(F.substring(a, F.instr(a, "@") + 1, F.length(a)))))


def addresses(values: Column) -> Column:
    """Lower-case, filled addresses."""
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), F.lower)


def redacted(text: Column, keep: list[str] | None = None) -> Column:
    """Addresses, links, amounts, numbers and names replaced by placeholders; names in keep stay."""
    keep = sorted({k.lower() for k in keep or []})
    quoted = lambda names: "|".join("\\Q" + n + "\\E" for n in names)
    not_these = lambda names: f"(?!(?iu:{quoted(names)})(?![\\w'-]))" if names else ""
    out = text
    for pattern, put in ((P.EMAIL_ADDRESS, "[EMAIL]"), (P.URL, "[URL]"), (P.AMOUNT, "[\\$AMOUNT]"), (P.PHONE, "[PHONE]"), (P.STREET, "[ADDRESS]")):
        out = F.regexp_replace(out, pattern, put)
    out = F.regexp_replace(out, f"(?Udm)^(Hi|Hey|Hello|Dear)\\s+{not_these([*keep, *P.WEEKDAYS_MONTHS])}[A-Z][\\w'-]+", "$1 [FIRST]")
    out = let(out, lambda t: _bare_names_redacted(t, keep))
    closers = "Best regards|Best|Thanks|Cheers|Regards|Sincerely"
    name = "[A-Z][\\w'-]+"
    return F.regexp_replace(out, f"(?Udm)^({closers}),?\\s*\\n\\s*{not_these(keep)}{name}(?:\\s+{name})?\\s*$", "$1,\n[FIRST]")


def _bare_names_redacted(text: Column, keep: list[str]) -> Column:
    line = "[ \\t]*[A-Z][\\w'-]*(?:[ \\t]*,[ \\t]*[A-Z][\\w'-]*)*[ \\t]*,[ \\t]*"
    first = F.regexp_extract(text, f"(?Ud)\\A({line})(?=\\n|\\z)", 1)
    names = F.filter(F.transform(F.split(F.regexp_replace(strip(first), ",+$", ""), ","), strip), lambda n: n != "")
    put = F.array_join(F.transform(names, lambda n: F.when(F.lower(n).isin(keep), n).otherwise("[FIRST]") if keep else F.lit("[FIRST]")), ", ")
    plain = (first == "") | F.exists(names, lambda n: F.lower(n).isin(P.NOT_NAMES))
    return F.when(plain, text).otherwise(F.concat(put, F.lit(","), F.substring(text, F.length(first) + 1, F.length(text))))


def draft_id(created: Column, subject: Column) -> Column:
    """d-, the day in the stamp's own offset, and eight digits of a hash of stamp and subject."""
    day = F.when(F.try_to_timestamp(created).isNotNull(), F.regexp_replace(F.substring(created, 1, 10), "-", "")).otherwise("00000000")
    return F.concat(F.lit("d-"), day, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", created, subject).cast("binary")), 1, 8))
