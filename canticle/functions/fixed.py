"""Word lists and patterns whose exact contents define results."""

# Albums whose lower-cased name contains one of these are of low quality.
LOW_QUALITY_ALBUM_PARTS = (
    "-", ".", "null", "unknown", "drumless", "karaoke", "tribute", "instrumental", "cover",
    "made famous", "in the style of", "backing track", "minus one",
)

# Whole album names of low quality, for candidate scores.
LOW_QUALITY_ALBUMS = ("-", ".", "null", "unknown", "title", "e", "vari", "valirock", "drumless")

# Words that mark live recordings, remixes and covers.
LIVE_REMIX_WORDS = (
    "live", "acoustic", "unplugged", "remix", "remixed", "cover", "tribute", "karaoke", "instrumental",
    "demo", "outtake", "alternate", "bootleg", "medley",
)

# Patterns of titles that hold more than a title.
GARBAGE_TITLES = (
    r"(?i)^\d{1,4}\s*[-–—._]\s*",
    r"(?i)^[^-–—]+ - [^-–—]+ - ",
    r"(?i)^\d{1,2}\.\s+",
    r"""(?i)^[^'"]+\s+['"][^'"]+['"]$""",
    r"(?i)^[A-Za-z0-9\s]+ - [A-Za-z0-9\s]+$",
    r"(?i)\s+\([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)+\)$",
)

# Titles too common to look up by title alone.
COMMON_TITLES = (
    "home", "love", "intro", "outro", "interlude", "untitled", "track 1", "bonus track", "live", "remix",
    "acoustic", "instrumental", "prelude", "prologue", "epilogue", "finale", "happy birthday", "hallelujah", "amen",
)

# Album classes in order of precedence, with the parts that name them.
ALBUM_CLASS_PARTS = (
    ("live", ("live", "concert", "tour", "unplugged")),
    ("compilation", ("greatest hits", "best of", "collection", "anthology", "essential")),
    ("soundtrack", ("soundtrack", "ost", "motion picture")),
    ("remaster", ("remaster", "reissue")),
    ("deluxe", ("deluxe", "expanded", "anniversary", "special", "collector")),
)

# The same classes by whole words.
ALBUM_CLASS_WORDS = (
    ("live", r"\b(live|concert|tour|unplugged)\b"),
    ("compilation", r"\b(greatest\s+hits|best\s+of|collection|anthology|essential)\b"),
    ("soundtrack", r"\b(soundtrack|ost|motion\s+picture)\b"),
    ("remaster", r"\b(remaster(?:ed)?|reissue)\b"),
    ("deluxe", r"\b(deluxe|expanded|anniversary|special|collector)\b"),
)

# Order of preference of album classes, and their quality points.
ALBUM_ORDER = ("studio", "remaster", "deluxe", "compilation", "live", "soundtrack")
ALBUM_POINTS = {"studio": 40, "remaster": 25, "deluxe": 15, "compilation": 5, "soundtrack": -10, "live": -20}

# What a track or album name of no studio version matches.
NON_STUDIO = (
    r"\bremaster(ed)?\b", r"\bremix(ed)?\b", r"\blive\b", r"\bacoustic\b", r"\bradio edit\b", r"\bsingle version\b",
    r"\bdemo\b", r"\bbonus track\b", r"\bdeluxe\b", r"\banniversary\b", r"\bextended\b", r"\binstrumental\b",
    r"\bkaraoke\b",
)

# Patterns removed from titles, in order.
TITLE_PATTERNS = (
    r"(?i)\s*[-–—/]\s*(?:remaster(?:ed)?(?:\s+\d{4})?|(?:\d{4}\s+)?remaster(?:ed)?)",
    r"(?i)\s*[\(\[](?:remaster(?:ed)?(?:\s+\d{4})?|(?:\d{4}\s+)?remaster(?:ed)?)[\)\]]",
    r"(?i)\s*[\(\[](?:live(?:\s+(?:at|from|in)\s+[^)\]]+)?|acoustic(?:\s+version)?|unplugged)[\)\]]",
    r"(?i)\s*[-–—]\s*(?:live(?:\s+(?:at|from|in)\s+.+)?|acoustic(?:\s+version)?)",
    r"(?i)\s*[\(\[](?:deluxe|super\s+deluxe|expanded|anniversary|bonus\s+track(?:s)?|special|collector'?s?)(?:\s+edition)?[\)\]]",
    r"(?i)\s*[\(\[](?:radio\s+edit|single\s+version|album\s+version|extended(?:\s+(?:mix|version))?|original\s+mix|mono|stereo)[\)\]]",
    r"(?i)\s*[\(\[]edit[\)\]]",
    r"(?i)\s*[-–—]\s*edit\s*$",
    r"(?i)\s*[\(\[](?:explicit|clean|censored|instrumental|karaoke)[\)\]]",
    r"(?i)\s*[\(\[](?:demo(?:\s+version)?|alternate(?:\s+(?:take|version))?|outtake|take\s*\d+)[\)\]]",
    r"(?i)\s*[-–—]\s*\d{4}(?:\s+(?:version|mix|edit))?$",
    r"(?i)\s*[\(\[](?:feat\.?|ft\.?|featuring)\s+[^)\]]+[\)\]]",
    r"(?i)\s*[\(\[](?:sped\s+up|slowed(?:\s*\+\s*reverb)?|nightcore|daycore)[\)\]]",
    r"(?i)\s*[\(\[](?:reworked?|redux|re-?recorded|reimagined)[\)\]]",
    r"(?i)\s*[\(\[](?:v(?:ersion)?\s*)?\d[\)\]]",
    r"(?i)\s*[-–—]\s*(?:mono|stereo)(?:\s*/\s*\d{4}\s*remaster(?:ed)?)?",
    r"(?i)\s+(?:feat\.?|ft\.?|featuring)\s+.+$",
    r"(?i)\s*[-–—_]?\s*[a-z0-9]+\.(?:com|net|org|io|ru|de|fr|es|co\.uk)",
    r"(?i)\s*[\(\[](?:visuali[sz]er|lyric\s*video|official\s*video|audio|comentario|commentary)[\)\]]",
    r"(?i)\s*[\(\[]official\s+(?:audio|lyric\s+video|hd\s+video|music\s+video)[\)\]]",
    r"(?i)\s*[\(\[]con\s+[^)\]]+[\)\]]",
    r"(?i)\s*[\(\[]remaster(?:ed)?[\)\]]",
    r"(?i)\s*[\(\[](?:remasterizado|remasterizada|remasteris[eé]|rimasterizzato)[\)\]]",
    r"(?i)\s*[\(\[]original[\)\]]",
    r"(?i)\s*[\(\[]full(?:\s+version)?[\)\]]",
    r"(?i)\s*[-–—]\s*\d{4}\s+digital\s+remaster(?:ed)?\s*$",
    r"(?i)\s*[\(\[](?:disc|cd)\s*\d+[\)\]]",
    r"""(?i)\s*[-–—]\s*(?:single|lp|7["']?|12["']?)\s+version\s*$""",
    r"(?i)\s*[\(\[](?:bonus(?:\s+track)?|hidden\s+track)[\)\]]",
    r"(?i)\s*[\(\[]from\s+[^)\]]+[\)\]]",
    r"(?i)\s*[\(\[](?:uk|us|usa|original)\s+(?:mix|version|edit)[\)\]]",
    r"(?i)\s*[-–—]\s*[a-z0-9\s]+\s+(?:remix|mix|edit)\s*$",
    r"(?i)\s*[\(\[](?:[a-z]+\s+)?(?:session|sessions|take\s*\d+)[\)\]]",
    r"(?i)\s*[\(\[](?:live|concert|tour)(?:\s+\d{4})?[\)\]]",
    r"(?i)\s*[\(\[]prod\.?\s+(?:by\s+)?[^)\]]+[\)\]]",
    r"(?i)\s*[\(\[](?:copyright\s+free|no\s+copyright|royalty\s+free)[\)\]]",
    r"(?i)\s*[\(\[](?:official\s+)?music\s+video(?:\s+\d{4})?[\)\]]",
)

# Removed from titles before those, in order, with what takes their place.
TITLE_PREFIXES = (
    (r"(?i)\.(flac|mp3|wav|m4a|ogg|aac)$", ""),
    (r"(?i)^(?:track\s*)?\d{1,4}\s*[-–—._]\s*", ""),
    (r"^(?:0[1-9]|[1-9]\d?)\s+([A-Z])", "$1"),
    (r"^\[\d{1,2}\]\s*", ""),
    (r"^\d{1,3}\.\s*[^-–—]+\s*[-–—]\s*", ""),
)
TITLE_SUFFIXES = (r"\s*\[[^\]]+\]\s*$", r"\s*\(\d{4}\)\s*$", r"[�]+$")

# Patterns removed from artist names, in order, and what separates credited artists.
ARTIST_PATTERNS = (
    r"(?i)\s*[;]\s*.*",
    r"(?i)\s+(?:feat\.?|ft\.?|featuring|with|con|&|,|/)\s+.*",
    r"(?i)\s+(?:band|orchestra|ensemble|quartet|trio)$",
)
ARTIST_SEPARATOR = r"(?i)\s*(?:[&/,;•+×]|(?:\s+(?:x|vs\.?|and|with|con|feat\.?|ft\.?)\s+))\s*"

# Literal repairs of punctuation, in order.
PUNCTUATION = (
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("´", "'"), ("`", "'"), (" & ", " and "),
    ("?t ", "'t "), ("?s ", "'s "), ("?m ", "'m "), ("?ve ", "'ve "), ("?re ", "'re "), ("?ll ", "'ll "),
    (" s ", "'s "), (" t ", "'t "), (" m ", "'m "), (" ve ", "'ve "), (" re ", "'re "), (" ll ", "'ll "),
)

# Pitch classes.
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
NO_CHORD = ("N.C.", "NC", "N/C", "n.c.", "nc")

# What an error message contains, and the reason it stands for; the first match counts.
ERROR_REASONS = (
    ("not_found", ("not found", "404")),
    ("rate_limit", ("rate limit", "429")),
    ("timeout", ("timeout", "timed out")),
    ("api_error", ("api", "500", "503")),
)

# Clean-up of track and album display names, in order.
_REMASTER = r"(?:remaster(?:ed)?(?:\s+\d{4})?|(?:\d{4}\s+)?remaster(?:ed)?)"
TRACK_NAME_PATTERNS = (
    rf"(?i)\s*[\(\[]{_REMASTER}[\)\]]",
    rf"(?i)\s*[-–—]\s*{_REMASTER}",
    r"(?i)\s*[\(\[](?:live(?:\s+(?:at|from|in)\s+[^)\]]+)?|acoustic(?:\s+version)?|unplugged)[\)\]]",
    r"(?i)\s*[-–—]\s*(?:live(?:\s+(?:at|from|in)\s+.+)?|acoustic(?:\s+version)?)",
    r"(?i)\s*[\(\[](?:deluxe|super\s+deluxe|expanded|anniversary|bonus\s+track(?:s)?|special|collector'?s?)(?:\s+edition)?[\)\]]",
    r"(?i)\s*[\(\[](?:album\s+version|extended(?:\s+(?:mix|version))?|original\s+mix|mono|stereo)[\)\]]",
    r"(?i)\s*[\(\[](?:instrumental|karaoke)[\)\]]",
    r"(?i)\s*[\(\[](?:demo(?:\s+version)?|alternate(?:\s+(?:take|version))?|outtake)[\)\]]",
    r"(?i)\s*[\(\[](?:radio\s+edit|single\s+version|explicit|clean|paused)[\)\]]",
    r"(?i)\s*[\(\[](?:\d{4}\s+(?:version|mix|edit|remaster(?:ed)?))[\)\]]",
    r"(?i)\s*[-–—]\s*\d{4}(?:\s+(?:version|mix|edit))?$",
)
ALBUM_NAME_PATTERNS = (
    rf"(?i)\s*[\(\[]{_REMASTER}[\)\]]",
    rf"(?i)\s*[-–—]\s*{_REMASTER}",
    r"(?i)\s*[\(\[](?:deluxe|super\s+deluxe|expanded|anniversary|bonus\s+track(?:s)?|special|collector'?s?)(?:\s+edition)?[\)\]]",
    r"(?i)\s*[\(\[](?:explicit|clean)[\)\]]",
    r"(?i)\s*[-–—]\s*\d{4}(?:\s+(?:version|mix|edit))?$",
)

# Patterns removed from artist display names, in order.
ARTIST_NAME_PATTERNS = (
    r"(?i)\s+(?:feat\.?|ft\.?|featuring|with|&|,|;|\/)\s+.*",
    r"(?i)\s+(?:band|orchestra|ensemble|quartet|trio)$",
)

# What the analysis of failures strips off normalized titles.
VERSION_SUFFIX = r"(?i)\s*[\(\[].*?(remix|version|edit|remaster|live|mix|stereo|mono|radio|explicit|clean|deluxe).*?[\)\]]?\s*$"
VERSION_DASH = r"(?i)\s*-\s*(remix|version|remaster|live|edit).*$"
TRACK_NUMBER = r"^\d+[\.\-\s]+"

# Suffixes of chords inferred from notes.
CHORD_QUALITIES = {"major": "", "minor": "m", "dim": "dim", "dom7": "7", "min7": "m7"}

# Characters that keys of songs and titles leave out.
SONG_KEY_MARKS = r"""[.,!?'"():;\-–—]"""
DEDUP_KEY_MARKS = r"""[.,!?'"]"""

# Ranges of combining marks that folding drops.
MARK_RANGES = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0xFE20, 0xFE2F))

# Look-alike letters of sung words and their Latin ones, and what is levelled, in order.
LOOK_ALIKES = ("аеорсух", "aeopcyx")
SUNG_WORD_PATTERNS = (
    (r"([aeiou])\1+", "$1"),
    (r"([ao])h+", "$1"),
    (r"(?i)\bwh?o+a+h?\b", "o"),
    (r"(?i)(o+h?[-−])+o*h?", "o"),
    (r"(?i)(a+h?[-−])+a*h?", "a"),
    (r"\([a-z]+\)", ""),
    (r"\+\w+", ""),
    ("-", ""),
    (r"^[^\p{L}\p{N}]+", ""),
    (r"[^\p{L}\p{N}]+\z", ""),
)

# Letters of scripts that run from right to left.
RIGHT_TO_LEFT = "[֐-ࣿﬠ-﷿ﹰ-﻿]"

# Points for the gap between two durations in seconds.
DURATION_POINTS = ((2, 100), (5, 80), (10, 50), (15, 25), (30, 10), (45, 5), (60, 2))

# Scores at which classes of sound decide.
CLASS_LIMITS = {"music": 0.3, "voice_with_music": 0.15, "priority": 0.25, "voice_with_priority": 0.2, "voice_with_instrument": 0.15, "loud_music": 0.4, "voice_with_loud_music": 0.1}

# Weights of chord templates: notes outside, the root or another note of the chord as bass, a seventh.
CHORD_WEIGHTS = {"outside": 0.4, "root_bass": 0.8, "other_bass": 0.4, "seventh": 0.5}

# Intervals of the chord kinds, in the order in which equals are decided.
CHORD_STEPS = {"major": (0, 4, 7), "minor": (0, 3, 7), "dim": (0, 3, 6), "dom7": (0, 4, 7, 10), "min7": (0, 3, 7, 10)}
CHORD_SEVENTHS = ("dom7", "min7")

# What is taken off a score's token before it is tested for being a word. The bracket closes the class early, so few tokens have any of it.
SCORE_TOKEN_LEAD = r"""^["'“”‘’\\()\[]\{\}<>\]+"""
SCORE_TOKEN_TRAIL = r"""["'“”‘’\\()\[]\{\}<>:;,\\.\\?!\]+$"""
