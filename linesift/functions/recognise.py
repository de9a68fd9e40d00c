"""What names a line of code holds, by kind: rules written as examples of each language's syntax.

In an example, the capitalised words below stand for what is read, a blank for any white space or none, and everything
else for itself. A kind's examples are one pattern, so the names of a line come in the order of their places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the capitalised words of examples stand for; parenthesised parts are read.
PARTS = {
    "NAME": r"([A-Za-z_]\w*)", "TYPE": r"\*?([A-Za-z_]\w*)(?:\[[^\]]*\])?", "ANY": r"[A-Za-z_]\w*", "MODULE": r"([\w.]+)", "CAPS": r"([A-Z][A-Z0-9_]+)",
    "STRING": r"""["'`]([^"'`]+)["'`]""", "PATH": r"""["'`](/[^"'`]*)["'`]""", "VERB": r"((?i:get|post|put|patch|delete|head|options|all))", "PLACEHOLDER": r"""["']\$\{([^}:]+)""",
    "PACKAGE": r"([A-Za-z0-9@][\w.@/-]*(?:\[[\w,.-]+\])?)", "VERSION": r"(v?[~^<>=!*]*\d[^\s\"';#,]*)", "BOUND": r"((?:==|>=|<=|~=|!=)[^;#\s]+)",
    "END": r"(?=\s*(?:[;,#]|as\b|$))", "START": r"^\s*", "WORDS": r"(?:(?:export|default|abstract|public|private|protected|internal|static|sealed|partial|final|async|unsafe|const|pub(?:\([a-z: ]+\))?)\s+)*",
}

#: By kind: the examples of each language.
EXAMPLES = {
    "env": {
        "javascript": ["process.env.NAME", "process.env[ STRING", "import.meta.env.NAME"], "python": ["os.environ[ STRING", "os.environ.get( STRING", "os.getenv( STRING", "os.environ.pop( STRING"],
        "c#": ["Environment.GetEnvironmentVariable( STRING"], "powershell": ["$env:NAME"], "rust": ["env::var( STRING", "env!( STRING"], "go": ["os.Getenv( STRING", "os.LookupEnv( STRING"], "java": ["System.getenv( STRING"],
    },
    "import": {
        "javascript": ["from STRING", "STARTimport STRING", "import( STRING"], "python": ["STARTfrom MODULE import", "STARTimport MODULEEND"], "c#": ["STARTusing static MODULE ;", "STARTusing MODULE ;"], "rust": ["STARTuse MODULE"],
    },
    "require": {"javascript": ["require( STRING"], "ruby": ["STARTrequire STRING"]},
    "definition": {
        "python": ["STARTWORDSdef NAME", "STARTclass NAME"], "go": ["STARTfunc (ANY TYPE) NAME", "STARTfunc NAME", "STARTtype NAME"], "rust": ["STARTWORDSfn NAME", "STARTWORDSstruct NAME", "STARTWORDSenum NAME", "STARTWORDStrait NAME"],
        "javascript": ["STARTWORDSfunction* NAME", "STARTWORDSfunction NAME", "STARTWORDSclass NAME", "STARTWORDSinterface NAME", "STARTWORDStype NAME"],
    },
    "route": {
        "javascript": ["ANY.VERB( PATH"], "python": ["@ANY.route( PATH", "@ANY.VERB( PATH"], "java": ["@VERBMapping( STRING", "@RequestMapping( STRING", "@VERBMapping(value = STRING"], "c#": ["[HttpVERB( STRING", "[Route( STRING"],
        "go": ["HandleFunc( PATH", "Handle( PATH"],
    },
    "config key": {
        "javascript": ["config.get( STRING", "config[ STRING", "settings[ STRING", "options[ STRING"], "python": ["cfg.get( STRING", "settings.get( STRING", "settings.CAPS", "getini( STRING", "getoption( STRING"],
        "java": ["getProperty( STRING", "@Value( PLACEHOLDER"], "c#": ["Configuration[ STRING", "configuration[ STRING"],
    },
    "dependency": {
        "package.json": ['START"PACKAGE": "VERSION"'], "requirements": ["STARTPACKAGE BOUND"], "go.mod": ["STARTrequire PACKAGE VERSION", "STARTPACKAGE VERSION"], "cargo": ['STARTPACKAGE = "VERSION"', 'STARTPACKAGE = { version = "VERSION"'],
    },
}


#: Parts that begin or end with a letter or digit.
WORDY = {"NAME", "TYPE", "ANY", "MODULE", "CAPS", "VERB", "PACKAGE", "VERSION"}


def compiled(example: str) -> str:
    """A regular expression that both Python and Java read."""
    out, gap = "", False
    for piece in filter(None, re.split(f"({'|'.join(sorted(PARTS, key=len, reverse=True))}| )", example)):
        word = piece in WORDY or piece not in PARTS and bool(re.match(r"\w", piece))
        if piece == " ":
            gap = True
            continue
        if gap:  # two words need white space between them
            out += r"\s+" if word and ended else r"\s*"
        elif not out and (piece == "ANY" or word and piece not in PARTS):
            out += r"\b"
        out, gap, ended = out + PARTS.get(piece, re.escape(piece)), False, piece in WORDY or bool(re.search(r"\w$", piece))
    return out


PATTERNS = {kind: [compiled(e) for examples in languages.values() for e in examples] for kind, languages in EXAMPLES.items()}


#: Words that ask for a kind and stand in none of its examples.
MORE_WORDS = {"route": {"route", "router", "get", "post", "put", "patch", "delete"}, "dependency": {"depend", "version", "==", ">="}, "config key": {"config", "setting", "cfg", "property"}, "env": {"env"}}


def names_in(text: Column, kind: str) -> Column:
    """The names of a kind in a line, in the order of their places, each once; parts are joined by a dot, or a blank for
    routes and dependencies."""
    patterns = PATTERNS[kind]
    glue = " " if kind in ("route", "dependency") else "."
    groups = [re.compile(p).groups for p in patterns]
    found = F.regexp_extract_all(text, F.lit("|".join(re.sub(r"\((?!\?)", "(?:", p.replace(r"\(", "\0")).replace("\0", r"\(") for p in patterns)), F.lit(0))

    def name(hit: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, n in reversed(list(zip(patterns, groups))):
            out = F.when(hit.rlike(f"^(?:{p})$"), F.array_join(F.array(*(F.regexp_extract(hit, f"^(?:{p})$", i) for i in range(1, n + 1))), glue) if n else hit).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(found, name), lambda x: F.coalesce(x != "", F.lit(False))))


def asking_words() -> dict[str, list[str]]:
    """By kind: the words of a search pattern that may be about it, lower-cased."""
    parts = "|".join(sorted(PARTS, key=len, reverse=True))
    spelt = {kind: {w.lower() for examples in languages.values() for e in examples for w in re.findall(r"[A-Za-z]\w+", re.sub(parts, " ", e))} for kind, languages in EXAMPLES.items()}
    return {kind: sorted(words | MORE_WORDS.get(kind, set())) for kind, words in spelt.items()}
