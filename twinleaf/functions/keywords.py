"""Languages by file extension and the reserved words of each."""

import keyword

#: Extension (lower case) -> language.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".java": "Java", ".go": "Go", ".gs": "Gosu", ".gsx": "Gosu",
}

_JAVASCRIPT = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in "
    "instanceof let new null return static super switch this throw true try typeof undefined var void while with yield"
)
#: Words that keep their text under normalisation.
KEYWORDS = {
    "Python": frozenset(keyword.kwlist),
    "JavaScript": frozenset(_JAVASCRIPT.split()),
    "TypeScript": frozenset(
        (
            _JAVASCRIPT + " abstract any as asserts async await declare enum from implements infer interface is keyof module namespace never of "
            "override private protected public readonly satisfies type unique unknown"
        ).split()
    ),
    "Java": frozenset(
        (
            "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
            "implements import instanceof int interface long native new null package private protected public return short static strictfp super switch "
            "synchronized this throw throws transient true try var void volatile while"
        ).split()
    ),
    "Gosu": frozenset(
        (
            "abstract as assert block break case catch class classpath continue default do else enum erases eval exists extends false final finally for "
            "foreach function hiding if implements import in index interface new null override package property protected public readonly return static "
            "super switch this throw throws transient true try unless using var void where while"
        ).split()
    ),
    "Go": frozenset(
        (
            "break case chan const continue default defer else fallthrough false for func go goto if import interface map nil package range return select "
            "struct switch true type var"
        ).split()
    ),
}

#: Grammar node kinds that stand for names and for literals (fixed values): information for users, normalisation reads the tokens alone.
PROFILES = {
    "Python": ("identifier type_identifier", "string integer float true false none"),
    "JavaScript": ("identifier property_identifier shorthand_property_identifier", "string number true false null template_string"),
    "TypeScript": ("identifier property_identifier type_identifier shorthand_property_identifier", "string number true false null template_string"),
    "Java": ("identifier type_identifier", "string_literal decimal_integer_literal decimal_floating_point_literal true false null_literal"),
    "Gosu": ("identifier type_identifier", "string_literal decimal_integer_literal decimal_floating_point_literal true false null_literal"),
    "Go": ("identifier type_identifier field_identifier", "interpreted_string_literal raw_string_literal int_literal float_literal true false nil"),
}


def profile(language: str) -> tuple[frozenset[str], frozenset[str]]:
    """(identifier kinds, literal kinds) of a language; empty sets for an unknown one."""
    names, literals = PROFILES.get(language, ("", ""))
    return frozenset(names.split()), frozenset(literals.split())
