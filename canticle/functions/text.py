"""Text normalization as Column functions. All but the folding of non-ASCII letters stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canticle.functions import fixed
from canticle.plans.expr import let
from canticle.plans.names import unused


def java(pattern: str) -> str:
    """A pattern with Unicode-aware classes whose ``$`` is the very end, as Java reads it."""
    pattern = pattern.replace("(?i)", "(?iU)", 1) if pattern.startswith("(?i)") else "(?U)" + pattern
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def any_word(words: tuple[str, ...]) -> str:
    return java(r"(?i)\b(?:" + "|".join(words) + r")\b")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))


def removed(text: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, java(p), F.lit(""))
    return text


def punctuation(text: Column) -> Column:
    """Straight quotes, ``and`` for ``&``, repaired apostrophes, single spaces. Most texts end at one test; ``text`` is a plain column."""
    out = text
    for old, new in fixed.PUNCTUATION:
        out = F.replace(out, F.lit(old), F.lit(new))
    any_old = "|".join(rf"\Q{old}\E" for old, _ in fixed.PUNCTUATION)
    return F.when(text.rlike(any_old + r"|(?U)\s{2}"), F.regexp_replace(out, r"(?U)\s{2,}", " ")).otherwise(text)


def letter_table() -> dict[int, str]:
    """Latin spellings of letters that have no decomposition: Cyrillic and Greek by rows, Hebrew by row, and a few Latin ones."""
    rows = (
        ("абвгдезийклмнопрстуфыэ", "a b v g d e z i i k l m n o p r s t u f y e"),
        ("жхцчшщюяёъьіїєґ", "zh kh ts ch sh shch yu ya io _ _ i yi ye g"),
        ("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z i th i k l m n x o p r s s t y f ch ps o"),
        ("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "_ b g d h v z kh t y k k l m m n n s _ p p ts ts k r sh t"),
        ("æœøłđðþßħı", "ae oe o l d d th ss h i"),
    )
    table: dict[int, str] = {}
    for letters, spelled in rows:
        for letter, latin in zip(letters, spelled.split(), strict=True):
            latin = latin.replace("_", "")
            table[ord(letter)] = latin
            if len(letter.upper()) == 1 and letter.upper() != letter:
                table[ord(letter.upper())] = latin
    return table


LETTERS = letter_table()


def _mark(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in fixed.MARK_RANGES)


def _fold(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not _mark(c))
        return bare.translate(LETTERS).lower()

    return texts.map(one, na_action="ignore")


def folded(text: Column) -> Column:
    """Lower case without accents. Only rows with letters beyond ASCII visit Python."""
    other = text.rlike(r"[^\x00-\x7F]")
    fold = F.pandas_udf(_fold, "string")
    return F.when(other, fold(F.when(other, text))).otherwise(F.lower(text))


def without_the(text: Column, longer_than: int = 0) -> Column:
    return F.when(text.startswith("the ") & (F.octet_length(text) > longer_than), F.substring(text, F.lit(5), F.length(text))).otherwise(text)


#: What a text must hold for any pattern of a kind to match it, by how the pattern begins after white space; removals add nothing to a text.
KINDS = {"bracket": r"[\(\[]", "dash": r"[-–—/]", "credit": r"(?i)f(?:ea)?t"}
#: What lets any other pattern of titles match: a number or a marker in front, a dot, an underscore, a broken character.
OTHER = r"(?U)^\s*(?:\d|\[|(?i:track))|[._�]"


def kind_of(pattern: str) -> str:
    start = pattern.removeprefix("(?i)")
    if start.startswith(r"\s*[\(\["):
        return "bracket"
    if start.startswith((r"\s*[-–—]\s*", r"\s*[-–—/]\s*")):
        return "dash"
    return "credit" if start.startswith(r"\s+(?:feat") else "other"


def tidied_title(text: Column, artist_norm: Column | None = None) -> Column:
    """A punctuated title (a plain column) after all replacements. A title that only patterns of one kind can match meets those alone;
    one with nothing that any could match is left as it is."""
    has = {kind: text.rlike(test) for kind, test in KINDS.items()}
    rest = text.rlike(OTHER) if artist_norm is None else text.rlike(OTHER) | text.rlike("[-–—:]")
    out = None
    for kind in KINDS:
        alone = ~rest & has[kind]
        for other in KINDS:
            if other != kind:
                alone = alone & ~has[other]
        own = tuple(p for p in fixed.TITLE_PATTERNS if kind_of(p) == kind)
        tidied = removed(text, (*fixed.TITLE_SUFFIXES[:2], *own) if kind == "bracket" else own)
        out = F.when(alone, tidied) if out is None else out.when(alone, tidied)
    any_ = rest
    for test in has.values():
        any_ = any_ | test
    return out.when(any_, whole_chain(text, artist_norm)).otherwise(text)


def cleaned_title(text: Column, artist_norm: Column | None = None) -> Column:
    """A title after all replacements, before folding. With the artist's normalized name, that is cut off the front."""
    return whole_chain(punctuation(text), artist_norm)


def whole_chain(text: Column, artist_norm: Column | None = None) -> Column:
    for p, by in fixed.TITLE_PREFIXES:
        text = F.regexp_replace(text, java(p), F.lit(by))
    if artist_norm is not None:
        # The artist's name at the start, then a dash or colon: a literal comparison, then a fixed pattern on the rest.
        def cut(x: Column) -> Column:
            start = F.regexp_replace(x["t"], r"(?U)^\s+", "")
            rest = F.substring(start, F.length(x["a"]) + 1, F.length(start))
            hit = (F.octet_length(x["a"]) >= 3) & F.lower(start).startswith(F.lower(x["a"])) & rest.rlike(r"(?U)^\s*[-–—:]")
            return F.when(hit, F.regexp_replace(rest, r"(?U)^\s*[-–—:]\s*", "")).otherwise(x["t"])

        text = let(F.struct(text.alias("t"), artist_norm.alias("a")), cut)
    return removed(text, (*fixed.TITLE_SUFFIXES, *fixed.TITLE_PATTERNS))


def folded_title(cleaned: Column) -> Column:
    return let(F.btrim(folded(cleaned)), lambda t: without_the(t, 6))


def normalize_title(title: Column) -> Column:
    """A title without track numbers, file endings, editions, versions, credits and accents."""
    return folded_title(cleaned_title(title))


def normalize_title_with_artist(title: Column, artist: Column, aliases: dict[str, str] | None = None) -> Column:
    """The same, with the artist's own name cut off the front."""
    return folded_title(cleaned_title(title, normalize_artist(artist, aliases)))


def cleaned_artist(artist: Column) -> Column:
    return removed(punctuation(F.split(artist, "\\x00")[0]), fixed.ARTIST_PATTERNS)


def folded_artist(cleaned: Column, aliases: dict[str, str] | None = None) -> Column:
    def named(key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), key)

    def spelled(t: Column) -> Column:
        return F.regexp_replace(without_the(F.btrim(t)), r"(?:, the| \(the\))\z", "")

    out = let(folded(cleaned), spelled)
    if aliases:
        out = F.coalesce(named(F.lower(F.btrim(cleaned))), let(out, lambda t: F.coalesce(named(t), t)))
    return out


def normalize_artist(artist: Column, aliases: dict[str, str] | None = None) -> Column:
    """The first credited artist without ``the``, ensemble words and accents. ``aliases`` maps lower-case names."""
    return folded_artist(cleaned_artist(artist), aliases)


def with_norms(rows: DataFrame, aliases: dict[str, str] | None = None, artist_context: bool = True) -> DataFrame:
    """``rows`` (title, artist) with ``title_norm`` and ``artist_norm``. Texts are columns of their own on the way, so the
    replacements run once a row and not once a mention. Few input partitions are spread over all cores first."""
    artist_, title_ = unused(rows, "artist", "title")
    out = spread(rows).withColumn(artist_, cleaned_artist(F.col("artist"))).withColumn("artist_norm", folded_artist(F.col(artist_), aliases))
    context = F.col("artist_norm") if artist_context else None
    out = out.withColumn(title_, punctuation(F.col("title"))).withColumn(title_, tidied_title(F.col(title_), context)).withColumn("title_norm", folded_title(F.col(title_)))
    return out.drop(artist_, title_)


#: Bytes of one input partition, as Spark reads files.
SPREAD = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as there are cores if Spark's estimate is less than ``SPREAD`` bytes a core: such a table may be one
    task, and work on its rows is worth a small shuffle. Larger ones have partitions enough."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if rows.isStreaming or size >= cores * SPREAD else rows.repartition(cores)


def primary_artist(artist_norm: Column) -> Column:
    """The name before the first separator, null if there is none or the name is shorter than two bytes."""
    parts = F.split(artist_norm, java(fixed.ARTIST_SEPARATOR), 2)
    first = F.btrim(parts[0])
    return F.when((F.size(parts) > 1) & (F.octet_length(first) >= 2), without_the(first))


# Tests on names


def is_garbage_album(album: Column) -> Column:
    return F.coalesce(contains_any(F.lower(album), fixed.LOW_QUALITY_ALBUM_PARTS), F.lit(False))


def is_skipped_title(title: Column) -> Column:
    return title.rlike(r"(?i)\(paused\)")


def is_live_or_remix(text: Column) -> Column:
    return F.coalesce(text.rlike(any_word(fixed.LIVE_REMIX_WORDS)), F.lit(False))


def is_garbage_title(title: Column) -> Column:
    found = F.lit(False)
    for p in fixed.GARBAGE_TITLES:
        found = found | title.rlike(java(p))
    return found


def title_contains_artist(title: Column, artist: Column) -> Column:
    return (F.octet_length(F.lower(artist)) >= 3) & F.contains(F.lower(title), F.lower(artist))


def is_common_title(title_norm: Column) -> Column:
    return (F.octet_length(title_norm) < 3) | title_norm.isin(*fixed.COMMON_TITLES)


def is_studio_version(track: Column, album: Column) -> Column:
    return ~F.concat_ws(" ", track, F.coalesce(album, F.lit(""))).rlike("(?i)" + "|".join(fixed.NON_STUDIO))


def has_timestamps(lyrics: Column) -> Column:
    return F.coalesce(F.regexp_count(lyrics, F.lit(r"\[\d{2}:\d{2}\.\d{2}\]")) >= 5, F.lit(False))


def album_class(album: Column) -> Column:
    """Class by parts of the name; a null name is a studio album."""
    out = F.lit("studio")
    for name, parts in reversed(fixed.ALBUM_CLASS_PARTS):
        out = F.when(contains_any(F.lower(album), parts), name).otherwise(out)
    return out


def album_class_by_words(album: Column) -> Column:
    out = F.lit("studio")
    for name, pattern in reversed(fixed.ALBUM_CLASS_WORDS):
        out = F.when(F.lower(album).rlike(pattern), name).otherwise(out)
    return out


# Similarity


def jaccard(a: Column, b: Column) -> Column:
    """Word-set similarity: 1 for equal texts, 0 if one is empty."""
    x, y = (F.filter(F.array_distinct(F.split(t, r"(?U)\s+")), lambda w: w != "") for t in (a, b))
    both = let(x, lambda p: let(y, lambda q: F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(both)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length in characters; 1 for two empty texts."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def byte_similarity(a: Column, b: Column) -> Column:
    """1 - distance in characters / longer length in bytes; 1 for two empty texts."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def bare_words(text: Column) -> Column:
    """Lower case, ASCII word characters and single spaces only."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", "")
    return F.btrim(F.regexp_replace(kept, r"\s+", " "))


def fuzzy_score(query: Column, target: Column) -> Column:
    """How well a query fits a text: containment by length ratio, or words found whole (1) and as prefixes (0.7)."""

    def score(q: Column, t: Column) -> Column:
        inside = F.when(q == t, 1.0).when(F.contains(t, q), 0.7 + 0.3 * F.char_length(q) / F.char_length(t)).otherwise(0.0)
        ts = F.split(t, " ")
        first = lambda w: F.get(F.filter(ts, lambda x: x.startswith(w)), F.lit(0))  # noqa: E731  the first word that decides
        found = F.transform(F.split(q, " "), lambda w: F.when(first(w).isNull(), 0.0).when(first(w) == w, 1.0).otherwise(0.7))
        words = F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)
        return F.when((q == "") | (t == ""), 0.0).otherwise(F.greatest(inside, F.least(F.lit(1.0), words)))

    return let(bare_words(query), lambda q: let(bare_words(target), lambda t: score(q, t)))


def fuzzy_song_score(query: Column, title: Column, artist: Column) -> Column:
    return F.greatest(*[fuzzy_score(query, t) for t in (title, artist, F.concat_ws(" - ", artist, title))])


# Keys, slugs and hashes


def song_key(text: Column) -> Column:
    """Lower case, single spaces, without punctuation."""
    spaced = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.btrim(F.regexp_replace(spaced, fixed.SONG_KEY_MARKS, ""))


def display_track(name: Column) -> Column:
    return F.btrim(removed(name, fixed.TRACK_NAME_PATTERNS))


def display_album(name: Column) -> Column:
    return F.btrim(removed(name, fixed.ALBUM_NAME_PATTERNS))


def display_artist(name: Column) -> Column:
    """An artist's name without further credits and ensemble words."""
    return F.btrim(removed(name, fixed.ARTIST_NAME_PATTERNS))


def dedup_key(title: Column, artist: Column) -> Column:
    clean = lambda t: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+", " "), fixed.DEDUP_KEY_MARKS, ""))
    return F.concat(clean(display_artist(artist)), F.lit(":"), clean(display_track(title)))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "-")
    return F.btrim(dashed, F.lit("-"))


def song_path(id_: Column, title: Column, artist: Column) -> Column:
    part = lambda t, other: F.coalesce(F.nullif(slug(t), F.lit("")), F.lit(other))
    return F.concat(F.lit("/song/"), part(artist, "artist"), F.lit("/"), part(title, "track"), F.lit("-"), id_.cast("string"))


def id_in_slug(text: Column) -> Column:
    return F.regexp_extract(text, r"-(\d+)$", 1).try_cast("bigint")


def uuid_to_code(uuid: Column) -> Column:
    """A UUID as unpadded URL-safe base64, and back."""
    return F.translate(F.rtrim(F.base64(F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))), F.lit("=")), "+/", "-_")


def code_to_uuid(code: Column) -> Column:
    padded = F.rpad(F.translate(code, "-_", "+/"), 24, "=")
    digits = F.lower(F.hex(F.unbase64(padded)))
    return F.when(F.length(digits) == 32, F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def canonical_lines(text: Column) -> Column:
    """Line ends as \\n, no white space at the ends of lines or of the text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"(?m)[^\S\n]+$", ""), r"\s+\z", "")


def lines_sha256(text: Column) -> Column:
    return F.sha2(canonical_lines(text), 256)


def rolling_hash(text: Column) -> Column:
    """31-based rolling hash of the characters in 32 bits, as 8 hex digits."""
    chars = F.split(canonical_lines(text), "")
    step = lambda h, c: F.pmod(h * 31 + F.when(c == "", 0).otherwise(F.ascii(c)), F.lit(1 << 32))
    return F.lpad(F.lower(F.hex(F.aggregate(chars, F.lit(0).cast("long"), step))), 8, "0")


def lyric_token(word: Column) -> Column:
    """A sung word for comparison: look-alikes, held vowels, interjections, markers and hyphens levelled."""
    t = F.translate(F.lower(word), *fixed.LOOK_ALIKES)
    for p, by in fixed.SUNG_WORD_PATTERNS:
        t = F.regexp_replace(t, p, by)
    return t


def error_reason(message: Column) -> Column:
    out = F.lit("unknown")
    for reason, parts in reversed(fixed.ERROR_REASONS):
        out = F.when(contains_any(F.lower(message), parts), reason).otherwise(out)
    return out


def musical_key(key: Column, mode: Column) -> Column:
    name = F.get(F.array(*map(F.lit, fixed.SHARPS)), key)
    scale = F.when(mode == 1, " major").when(mode == 0, " minor").otherwise("")
    return F.when(key.between(0, 11), F.concat(name, scale))


def transpose_chord(chord: Column, semitones: Column) -> Column:
    """A chord moved by semitones; flats stay flats; bass notes after a slash move too."""

    def note(root: Column) -> Column:
        at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, fixed.SHARPS)), root), F.lit(0)), F.nullif(F.array_position(F.array(*map(F.lit, fixed.FLATS)), root), F.lit(0)))
        to = F.pmod(at - 1 + semitones, F.lit(12)).cast("int")
        names = F.when(F.contains(root, F.lit("b")), F.get(F.array(*map(F.lit, fixed.FLATS)), to)).otherwise(F.get(F.array(*map(F.lit, fixed.SHARPS)), to))
        return F.coalesce(names, root)

    def one(text: Column) -> Column:
        root = F.regexp_extract(text, r"^([A-G][#b]?)", 1)
        return F.when(root == "", text).otherwise(F.concat(note(root), F.substring(text, F.length(root) + 1, F.length(text))))

    parts = F.split(chord, "/")
    slashed = F.when((parts[0] == "") | (parts[1] == ""), chord).otherwise(F.concat(one(parts[0]), F.lit("/"), one(parts[1])))
    moved = F.when(F.contains(chord, F.lit("/")), slashed).otherwise(one(chord))
    return F.when((semitones == 0) | chord.isin(*fixed.NO_CHORD), chord).otherwise(moved)


def extracted_chord(root: Column, quality: Column) -> Column:
    """A chord's name from its root's pitch class and its quality."""
    suffixes = F.create_map(*[F.lit(x) for pair in fixed.CHORD_QUALITIES.items() for x in pair])
    return F.concat(F.get(F.array(*map(F.lit, fixed.SHARPS)), F.pmod(root, F.lit(12)).cast("int")), F.element_at(suffixes, quality))


def chord_name(base: Column, suffix: Column, bass: Column) -> Column:
    """A chord's name; its lowest note follows a slash where that isn't the base note."""
    return F.concat(base, suffix, F.when(bass != base, F.concat(F.lit("/"), bass)).otherwise(""))


def proportional_index(at: Column, source: Column, target: Column) -> Column:
    """The place in ``target`` in proportion to ``at`` in ``source``; off a space to the nearest other character within 4, the left first."""
    n = F.char_length(target)
    about = F.greatest(F.lit(0), F.least(n - 1, js_round(at / F.greatest(F.char_length(source), F.lit(1)) * n)))
    good = lambda k: (k >= 0) & (k < n) & (F.substring(target, (k + 1).cast("int"), F.lit(1)) != " ")
    steps = [about]
    for delta in range(1, 5):
        steps += [about - delta, about + delta]
    return F.when(n > 0, F.coalesce(*[F.when(good(k), k) for k in steps], about).cast("int"))


def proportional_time(at: Column, text: Column, start: Column, end: Column) -> Column:
    """Time into a line in proportion to a character's place; an empty interval counts as 3000."""
    return at / F.greatest(F.char_length(text), F.lit(1)) * F.when(end == start, 3000).otherwise(end - start)


def format_number(n: Column, letters: str = "KMB") -> Column:
    """A whole count with two decimals and K, M or B (those in ``letters``) from a thousand on. Halves go where the quotient's double lies."""
    out = n.cast("string")
    for k, letter in enumerate(letters, 1):
        size = 1000**k
        step = size // 100
        quotient = n / F.lit(float(size))
        part = ((quotient - F.floor(quotient)) * float(1 << 52)).cast("bigint")  # of the double's fraction, exactly: from 1 on it has 52 bits at most
        high = part.cast("decimal(17,0)") * F.lit(size).cast("decimal(10,0)") >= (n % size).cast("decimal(10,0)") * F.lit(1 << 52).cast("decimal(17,0)")
        up = F.when(n % step * 2 == step, high).otherwise(n % step * 2 > step)
        hundredths = F.floor(n / step) + up.cast("int")
        out = F.when(n >= size, F.format_string(f"%d.%02d{letter}", F.floor(hundredths / 100), hundredths % 100)).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    return F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60)


def catalog_id(text: Column) -> Column:
    """The 22-character id in a share link or URI, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?:track[:/])?([A-Za-z0-9]{22})(?:\?.*)?$", 1), F.lit(""))


# Time stamps


def stamp_seconds(stamp: Column) -> Column:
    """``[mm:ss.ff]`` to seconds; the fraction is padded or cut to two digits."""
    pattern = r"\[(\d+):(\d+)(?:\.(\d+))?\]"
    part = lambda k: F.regexp_extract(stamp, pattern, k)
    return F.when(part(1) != "", part(1).try_cast("int") * 60 + part(2).try_cast("int") + F.rpad(part(3), 2, "0").try_cast("int") / 100)


def stamp_millis(stamp: Column) -> Column:
    """``[mm:ss.fff]`` to milliseconds; two or three digits of fraction."""
    pattern = r"\[(\d+):(\d+)\.(\d{2,3})\]"
    part = lambda k: F.regexp_extract(stamp, pattern, k)
    return F.when(part(1) != "", (part(1).try_cast("bigint") * 60 + part(2).try_cast("int")) * 1000 + F.rpad(part(3), 3, "0").try_cast("int"))


def format_stamp(seconds: Column) -> Column:
    whole = F.floor(seconds % 60)
    return F.format_string("%02d:%02d.%02d", F.floor(seconds / 60), whole, F.floor((seconds % 60 - whole) * 100 + 0.5))


def js_round(x: Column) -> Column:
    """Half up towards plus infinity."""
    return F.floor(x + 0.5)
