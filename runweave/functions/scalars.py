"""Column functions over texts, commands, addresses, events and counters. Null gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of giving up (fixed values).
SURRENDER = (
    r"\bnot solved\b", r"\bgiv(?:e|es|en|ing) up\b", r"\b(?:cannot|can't|unable to) (?:continue|proceed|solve|complete|finish)\b",
    r"\bdecid(?:e|ed|ing) to (?:halt|stop)\b", r"\b(?:halt|stop)(?:ping)? further attempts\b", r"\bno (?:viable|productive) (?:path|route|approach) remains\b",
)
#: Patterns of entries that try to steer a reader or to carry secrets off, in their order (fixed values).
ENTRY_THREATS = (
    ("prompt_injection", r"ignore\s+(?:previous|all|above|prior)\s+instructions"), ("role_hijack", r"you\s+are\s+now\s+"), ("deception_hide", r"do\s+not\s+tell\s+the\s+user"),
    ("sys_prompt_override", r"system\s+prompt\s+override"), ("disregard_rules", r"disregard\s+(?:your|all|any)\s+(?:instructions|rules|guidelines)"),
    ("bypass_restrictions", r"act\s+as\s+(?:if|though)\s+you\s+(?:have\s+no|don't\s+have)\s+(?:restrictions|limits|rules)"),
    ("exfil_curl", r"curl\s+[^\n]*\$\{?\w*(?:KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)"), ("exfil_wget", r"wget\s+[^\n]*\$\{?\w*(?:KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)"),
    ("read_secrets", r"cat\s+[^\n]*(?:\.env|credentials|\.netrc|\.pgpass|\.npmrc|\.pypirc)"), ("ssh_backdoor", r"authorized_keys"), ("ssh_access", r"\$HOME/\.ssh|~/\.ssh"),
)
#: Characters that are not seen (fixed values), for a character class.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e"
#: Dangerous commands, the first that fits counts (fixed values); the third entry, if any, must not fit.
DANGEROUS = (
    ("delete in root path", r"\brm\s+(-[^\s]*\s+)*/"), ("recursive delete", r"\brm\s+-[^\s]*r"), ("recursive delete (long flag)", r"\brm\s+--recursive\b"), ("world-writable permissions", r"\bchmod\s+(-[^\s]*\s+)*777\b"),
    ("recursive world-writable (long flag)", r"\bchmod\s+--recursive\b.*777"), ("recursive chown to root", r"\bchown\s+(-[^\s]*)?r\s+root"), ("recursive chown to root (long flag)", r"\bchown\s+--recursive\b.*root"),
    ("format filesystem", r"\bmkfs\b"), ("disk copy", r"\bdd\s+.*if="), ("write to block device", r">\s*/dev/sd"), ("SQL DROP", r"\bdrop\s+(table|database)\b"),
    ("SQL DELETE without WHERE", r"\bdelete\s+from\b", r"\bdelete\s+from\b.*\bwhere\b"), ("SQL TRUNCATE", r"\btruncate\s+(table)?\s*\w"), ("overwrite system config", r">\s*/etc/"),
    ("stop/disable system service", r"\bsystemctl\s+(stop|disable|mask)\b"), ("kill all processes", r"\bkill\s+-9\s+-1\b"), ("force kill processes", r"\bpkill\s+-9\b"),
    ("fork bomb", r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:"),
    ("shell command via -c flag", r"\b(bash|sh|zsh)\s+-c\s+"), ("script execution via -e/-c flag", r"\b(python[23]?|perl|ruby|node)\s+-[ec]\s+"), ("pipe remote content to shell", r"\b(curl|wget)\b.*\|\s*(ba)?sh\b"),
    ("execute remote script via process substitution", r"\b(bash|sh|zsh|ksh)\s+<\s*<?\s*\(\s*(curl|wget)\b"),
    # A file of secrets in any hidden folder of the user's counts.
    ("overwrite system file via tee", r"\btee\b.*(/etc/|/dev/sd|\.ssh/|\.\w+/\.env)"),
    ("xargs with rm", r"\bxargs\s+.*\brm\b"), ("find -exec rm", r"\bfind\b.*-exec\s+(/\S*/)?rm\b"), ("find -delete", r"\bfind\b.*-delete\b"),
)
#: Blocker kinds by the words that tell them, the first that fits counts (fixed values).
BLOCKERS = (
    ("axiom-risk", ("axiom", "#print axioms", "classical.choice")), ("unknown_ident", ("unknown constant", "unknown identifier", "unknown namespace")),
    ("synth_instance", ("failed to synthesize", "type class", "instance")), ("type_mismatch", ("type mismatch", "application type mismatch")),
    ("timeout", ("timeout", "maximum recursion depth", "maximum number of heartbeats")), ("open_goals", ("⊢", "unsolved goals")),
)
#: Words of a failed attempt's reason that speak for the infrastructure (fixed values).
INFRASTRUCTURE = ("infrastructure", "provider", "unavailable", "connection error", "connectionerror", "api error", "apierror", "rate limit", "too many requests")
#: Hosts of public repositories, whole or as an ending (fixed values of this library's default).
REPOSITORY_HOSTS, REPOSITORY_ENDINGS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "raw.githubusercontent.com"), (".github.com", ".githubusercontent.com", ".gitlab.io")
#: Patterns that name a context limit, the first within bounds counts (fixed values).
LIMITS = (
    r"(?:max(?:imum)?|limit)\s*(?:context\s*)?(?:length|size|window)?\s*(?:is|of|:)?\s*(\d{4,})", r"context\s*(?:length|size|window)\s*(?:is|of|:)?\s*(\d{4,})",
    r"(\d{4,})\s*(?:token)?\s*(?:context|limit)", r">\s*(\d{4,})\s*(?:max|limit|token)", r"(\d{4,})\s*(?:max(?:imum)?)\b",
)
IMAGE = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+"
CUT, EARLIER, LATER = "\n\n[... middle omitted ...]\n\n", "...[earlier text cut]...\n\n", "\n\n...[later text cut]..."


def digest(n: int, *columns: Column) -> Column:
    """The first n hex digits of the SHA-256 of the columns, joined by a unit separator; null counts as ''."""
    return F.left(F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256), F.lit(n))


def semantic_text(text: Column) -> Column:
    """Lower case with job names, times, UUIDs, hashes and counters as placeholders and blanks collapsed."""
    out = F.lower(text)
    for pattern, becomes in (
        (r"(?<![a-z0-9_])(?:[a-z0-9][a-z0-9_-]*\.)*orchestrator\.(?:dc|ds|em|np|pv)-\d+\b", "\\$job"), (r"(?<![a-z0-9_])(?:dc|ds|em|np|pv)-\d+\b", "\\$job"),
        (r"\b\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?\b", "\\$timestamp"), (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "\\$uuid"),
        (r"\b(?=[0-9a-f]{16,64}\b)(?=[0-9]*[a-f])[0-9a-f]{16,64}\b", "\\$hash"),
        (r"\b(?:attempt(?:_count)?|cycle|epoch|generation|iteration|job|nonce|refresh|route(?:[-_\s]?set)?|worker)\s*(?:[:=#]\s*)?\d+\b", "\\$counter"),
    ):
        out = F.regexp_replace(out, pattern, becomes)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Words that tell the mechanism of a route, names of Greek letters, and words that say nothing (fixed values).
MECHANISMS = (
    ("algebraic-identity", r"\b(?:algebra|factor|identity|polynomial|ring)\w*\b"), ("decomposition", r"\b(?:decompos|helper|intermediate\s+lemma|split|sublemma)\w*\b"), ("finite-enumeration", r"\b(?:bounded|case\s+split|enumerat|finite|witness)\w*\b"),
    ("induction", r"\b(?:induct|recurr|strong\s+induction)\w*\b"), ("inequality", r"\b(?:bound|convex|inequal|monot|nonnegative|order)\w*\b"), ("library-search", r"\b(?:library|mathlib|retrieve|search|theorem\s+search)\w*\b"),
    ("modular-arithmetic", r"\b(?:congru|modulo|modulus|residue|zmod)\w*\b"), ("negation", r"\b(?:contradiction|counterexample|disprov|negat|obstruction)\w*\b"), ("number-theory", r"\b(?:coprime|divid|divis|gcd|lcm|prime|valuation)\w*\b"),
)
GREEK = ("alpha", "beta", "delta", "epsilon", "eta", "gamma", "iota", "kappa", "lambda", "mu", "nu", "omega", "omicron", "phi", "pi", "psi", "rho", "sigma", "tau", "theta", "upsilon", "xi", "zeta")
EMPTY_WORDS = ("at", "finding", "route", "source")


def route_features(text: Column) -> Column:
    """Sorted array: mechanisms that a route's text names, `atom:` and what stands in backticks, `constant:` and numbers."""
    return let(semantic_text(text), _route_features)


def let(value: Column, use) -> Column:
    """use(value), with the value found once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _route_features(plain: Column) -> Column:
    named = F.filter(F.array(*[F.when(plain.rlike(pattern), F.lit(name)) for name, pattern in MECHANISMS]), lambda m: m.isNotNull())
    real = lambda t: F.exists(F.regexp_extract_all(t, F.lit(r"[a-z_][a-z0-9_]*|\d+"), 0), lambda w: ~w.isin(*EMPTY_WORDS))
    atoms = F.transform(F.filter(F.regexp_extract_all(plain, F.lit(r"`([^`\n]{1,120})`"), 1), real), lambda a: F.concat(F.lit("atom:"), F.trim(a)))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"(?<![$A-Za-z_])\d+(?![A-Za-z_])"), 0), lambda n: F.concat(F.lit("constant:"), n))
    return F.sort_array(F.array_distinct(F.concat(named, atoms, numbers)))


def target_symbols(text: Column) -> Column:
    """Sorted array of the symbols of a target's text: single letters but a and i, Greek names, and names with signs or digits."""
    words = F.regexp_extract_all(semantic_text(text), F.lit(r"(?<![$A-Za-z0-9_'])[a-z][a-z0-9_'.]*(?![A-Za-z0-9_'])"), 0)
    symbol = lambda w: ((F.length(w) == 1) & ~w.isin("a", "i")) | w.isin(*GREEK) | w.rlike(r"[_.'0-9]")
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: symbol(w) & ~w.isin(*EMPTY_WORDS))))


def _renamed(name: str, other: str):
    return lambda c: F.when(c == name, other).otherwise(c)


def concepts(text: Column, patterns: dict[str, str], aliases: dict[str, str] | None = None) -> Column:
    r"""Names of the patterns that a text fits, then its \operatorname{...} names (with aliases), each once."""
    named = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), name) for name, p in patterns.items()]))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\\operatorname\{([^{}]+)\}"), 1), lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    for name, other in (aliases or {}).items():
        found = F.transform(found, _renamed(name, other))
    return F.array_distinct(F.concat(named, F.filter(found, lambda c: c != "")))


def blocker_kind(text: Column) -> Column:
    """The first kind of BLOCKERS of which a text has a word; else sorry, warnings, diagnostics, or none for a blank one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.contains("sorry"), "sorry").when(low.contains("warning:"), "warnings").when(F.trim(low) != "", "diagnostics").otherwise("none")
    for kind, words in reversed(BLOCKERS):
        out = F.when(low.rlike("|".join(w.replace(".", r"\.") for w in words)), kind).otherwise(out)
    return out


def failure_class(success: Column, given: Column, reason: Column, stage: Column) -> Column:
    """'' for a success, else the given class, else what the reason tells, else what the stage leaves incomplete."""
    low, given = F.lower(F.coalesce(reason, F.lit(""))), F.trim(F.coalesce(given, F.lit("")))
    return (
        F.when(F.coalesce(success, F.lit(False)), "").when(given != "", given).when(low.contains("cost limit") | low.contains("budget"), "budget_limit").when(low.contains("timeout"), "verification_timeout")
        .when(low.rlike("|".join(INFRASTRUCTURE)), "infrastructure").when(stage == "statements", "statement_generation_incomplete").otherwise("proof_incomplete")
    )


def compact_count(n: Column) -> Column:
    """1234 as 1.23K, 12345 as 12.3K, 123456 as 123K; likewise M and B; ties round up, zeros after the point go."""
    size, out = F.abs(n.cast("long")), n.cast("string")
    for unit, suffix in ((10**3, "K"), (10**6, "M"), (10**9, "B")):
        text = F.lit(None).cast("string")
        for digits in (0, 1, 2):
            scale = 10**digits
            r = F.floor((size * scale + unit // 2) / F.lit(unit).cast("decimal(20,0)")).cast("long")
            whole = F.floor(r / scale).cast("string") if digits else r.cast("string")
            rest = F.regexp_replace(F.lpad((r % scale).cast("string"), digits, "0"), "0+$", "") if digits else F.lit("")
            made = F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
            text = made if not digits else F.when(size < unit * 10 ** (3 - digits), made).otherwise(text)
        out = F.when(size >= unit, F.concat(F.when(n < 0, "-").otherwise(""), text, F.lit(suffix))).otherwise(out)
    return out


def compact_duration(seconds: Column) -> Column:
    """Whole seconds as 45s, 12m, 3h 5m, 3h or 2.5d (ties of tenths of a day round up)."""
    s = seconds.cast("double")
    tenths = F.floor((seconds.cast("long") * 10 + 43200) / 86400)
    left = F.floor(F.pmod(s / 60, F.lit(60.0)))
    hours = F.floor(s / 3600).cast("string")
    return F.when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.bround(s / 60, 0).cast("long").cast("string"), F.lit("m"))).when(
        s < 86400, F.when(left > 0, F.concat(hours, F.lit("h "), left.cast("string"), F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))
    ).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("d")))


def clean_title(title: Column, most: int = 100) -> Column:
    """A title without control and unseen characters, blanks collapsed; null if blank or over `most` characters."""
    out = F.regexp_replace(title, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"[\u200b-\u200f\u2028-\u202e\u2060-\u2069\ufeff\ufffc\ufff9-\ufffb]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when((out != "") & (F.length(out) <= most), out)


def context_limit(error: Column, low: int = 1024, high: int = 10_000_000) -> Column:
    """The context limit that an error text names (long), by the first of LIMITS that gives one within bounds; else null."""
    # Only texts with a number of four digits are looked at, and each pattern once.
    found = lambda t: F.array(*[F.regexp_extract(t, p, 1).try_cast("long") for p in LIMITS])
    return F.when(error.rlike(r"\d{4}"), F.get(F.filter(let(F.lower(error), found), lambda n: n.between(low, high)), 0))


def module_name(path: Column, ending: str) -> Column:
    """a/b/c.ending as a.b.c; null for other paths."""
    return F.when(path.endswith(f".{ending}"), F.translate(F.regexp_replace(F.regexp_replace(path, r"^(?:\./|/)+", ""), rf"\.{ending}$", ""), "/", "."))


def imports(text: Column) -> Column:
    """Modules of the import lines of a text in their order, each once; `--` comments do not count."""
    bare = F.regexp_replace(text, r"--[^\n]*", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*import\s+([A-Za-z_][A-Za-z0-9_']*(?:\.[A-Za-z_][A-Za-z0-9_']*)*)"), 1))


def missing_modules(result: Column) -> Column:
    """First parts of the modules that a result says are missing, in their order, each once."""
    return F.array_distinct(F.regexp_extract_all(result, F.lit(r"(?i)No module named\s+['\"]([A-Za-z_]\w*)(?:\.[A-Za-z_]\w*)*['\"]"), 1))


def frontmatter(text: Column) -> Column:
    """The flat `key: value` lines between --- lines at the head of a document as a map; empty without any."""
    head = F.regexp_extract(text, r"^---([\s\S]*?)\n---\s*\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda line: line.contains(":"))
    pair = lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("v"))
    return F.map_from_entries(F.transform(lines, pair))


def tags(value: Column) -> Column:
    """'[a, "b"]' or 'a, b' as an array; null and blank give none."""
    inner = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^\[([\s\S]*)\]$", "$1")
    return F.filter(F.transform(F.split(inner, ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']+|[\"']+$", "")), lambda t: t != "")


def to_time(value: Column) -> Column:
    """A timestamp from ISO text or from seconds since 1970 as text; null where it is neither."""
    return F.coalesce(F.timestamp_seconds(F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value).try_cast("double")), value.try_cast("timestamp"))


def repository_url(url: Column) -> Column:
    """Whether an address is on a host of public repositories; addresses without a scheme count too."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1)), r"\.+$", "")
    out = host.isin(*REPOSITORY_HOSTS)
    for ending in REPOSITORY_ENDINGS:
        out = out | host.endswith(ending)
    return out


def unsafe_entry(text: Column) -> Column:
    """Why an entry is unsafe: invisible, else the first of ENTRY_THREATS that fits; null if it is not."""
    return F.coalesce(F.when(text.rlike(f"[{INVISIBLE}]"), "invisible"), *[F.when(text.rlike(f"(?i){p}"), name) for name, p in ENTRY_THREATS])


def command_risk(command: Column) -> Column:
    """The first of DANGEROUS that a command fits; null for none."""
    low = F.lower(command)
    fits = lambda p: low.rlike(f"(?s){p}")
    return F.coalesce(*[F.when(fits(p) & ~(fits(other[0]) if other else F.lit(False)), name) for name, p, *other in DANGEROUS])


def surrenders(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(SURRENDER)), F.lit(False))


def open_scratchpad(text: Column, tag: str = "REASONING_SCRATCHPAD") -> Column:
    """Whether a tag is opened and never closed."""
    return F.coalesce(text.contains(f"<{tag}>") & ~text.contains(f"</{tag}>"), F.lit(False))


def strip_images(text: Column, mark: str = "[BASE64_IMAGE_REMOVED]") -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\({IMAGE}\)", mark), IMAGE, mark)


def excerpt(text: Column, n: int, marker: str = CUT) -> Column:
    """A stripped text of at most n characters as it is; of a longer one head (2/3) and tail, which with the marker have n at most."""
    room = n - len(marker)
    head = max(0, room * 2 // 3)
    tail = max(0, room - head)
    strip = lambda c, side: F.regexp_replace(c, {"both": r"^\s+|\s+$", "left": r"^\s+", "right": r"\s+$"}[side], "")
    raw = strip(text, "both")
    return F.when(F.length(raw) <= n, raw).otherwise(strip(F.concat(strip(F.substring(raw, 1, head), "right"), F.lit(marker), strip(F.right(raw, F.lit(tail)), "left")), "both"))


def window_text(text: Column, terms: tuple[str, ...], n: int) -> Column:
    """n characters of a text around the first of the terms in it (else from its start), with marks where it is cut."""
    places = F.array(*[F.instr(F.lower(text), term.lower()) for term in terms])
    first = F.coalesce(F.array_min(F.filter(places, lambda p: p > 0)) - 1, F.lit(0))
    size = F.length(text)
    start = F.greatest(first - n // 2, F.lit(0))
    end = F.least(size, start + n)
    start = F.when(end - start < n, F.greatest(end - n, F.lit(0))).otherwise(start)
    cut = F.concat(F.when(start > 0, EARLIER).otherwise(""), F.substring(text, start + 1, end - start), F.when(end < size, LATER).otherwise(""))
    return F.when(size <= n, text).otherwise(cut)


def tool_priority(name: Column, action: Column) -> Column:
    """Rank of a tool call, lower first: edits, checks of the target, other checks, verification, all else, inspection (fixed values)."""
    action = F.translate(F.lower(F.trim(F.coalesce(action, F.lit("")))), "-", "_")
    return F.when(name == "apply_verified_patch", -10).when(name == "lean_incremental_check", F.when(action.isin("", "check_target"), 0).otherwise(1)).when(name.isin("lean_verify", "lean_axioms"), 2).when(name == "lean_inspect", 20).otherwise(10)


def compact_event(fields: tuple[str, ...], message: Column, details: Column, keep: tuple[str, ...], most: int = 500) -> Column:
    """A struct of an event's fields, its message cut to `most` characters, and those details (a map) that are kept and known."""
    kept = F.map_filter(details, lambda k, v: k.isin(*keep) & v.isNotNull())
    return F.struct(*fields, F.when(F.length(message) > most, F.concat(F.substring(message, 1, most - 3), F.lit("..."))).otherwise(message).alias("message"), kept.alias("details"))


#: Beginnings of credentials (fixed values).
CREDENTIALS = (
    r"sk-[A-Za-z0-9_-]{10,}", r"ghp_[A-Za-z0-9]{10,}", r"github_pat_[A-Za-z0-9_]{10,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"AIza[A-Za-z0-9_-]{30,}", r"pplx-[A-Za-z0-9]{10,}", r"fal_[A-Za-z0-9_-]{10,}",
    r"fc-[A-Za-z0-9]{10,}", r"bb_live_[A-Za-z0-9_-]{10,}", r"gAAAA[A-Za-z0-9_=-]{20,}", r"AKIA[A-Z0-9]{16}", r"sk_live_[A-Za-z0-9]{10,}", r"sk_test_[A-Za-z0-9]{10,}", r"rk_live_[A-Za-z0-9]{10,}",
    r"SG\.[A-Za-z0-9_-]{10,}", r"hf_[A-Za-z0-9]{10,}", r"r8_[A-Za-z0-9]{10,}", r"npm_[A-Za-z0-9]{10,}", r"pypi-[A-Za-z0-9_-]{10,}", r"dop_v1_[A-Za-z0-9]{10,}", r"doo_v1_[A-Za-z0-9]{10,}", r"am_[A-Za-z0-9_-]{10,}",
)
#: What is redacted, in this order, and what it becomes (fixed values).
REDACTIONS = (
    (r"(?<![A-Za-z0-9_-])(?<![A-Za-z0-9_-]\.)eyJ[A-Za-z0-9_-]{13,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])(?!\.[A-Za-z0-9_-])", "***"),
    (rf"(?<![A-Za-z0-9_-])(?:{'|'.join(CREDENTIALS)})(?![A-Za-z0-9_-])", "***"),
    (r"(?i)([A-Z_]*(?:API_?KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL|AUTH)[A-Z_]*)\s*=\s*(['\"]?)(\S+)\2", "$1=$2***$2"),
    (r'(?i)("(?:api_?key|token|secret|password|access_token|refresh_token|auth_token|bearer|secret_value|raw_secret|secret_input|key_material)")\s*:\s*"[^"]+"', '$1: "***"'),
    (r"(?i)(Authorization:\s*Bearer\s+)\S+", "$1***"), (r"(?:bot)?\d{8,}:[-A-Za-z0-9_]{30,}", "[REDACTED]"),
    (r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]*?-----END[A-Z ]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"), (r"(?i)((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^:]+:)[^@]+@", "$1***@"),
    (r"(\+[1-9]\d{2})\d{1,8}(\d{4})(?![A-Za-z0-9])", "$1****$2"), (r"(\+[1-9])\d{4}(\d{2})(?![A-Za-z0-9])", "$1****$2"),
)


def redact(text: Column) -> Column:
    """A text without web tokens, credentials, secret assignments and fields, bearer headers, keys, passwords in addresses and phone numbers."""
    for pattern, becomes in REDACTIONS:
        text = F.regexp_replace(text, pattern, becomes)
    return text
