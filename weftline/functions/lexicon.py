"""Word lists and patterns of the copy gate."""

from __future__ import annotations

#: Words of structural English.
GLUE_WORDS = frozenset(
    """
    a an and as at be by for from in is it of on or that the to was were with
    """.split()
)

#: Words without subject matter.
FUNCTION_WORDS = GLUE_WORDS | frozenset(
    """
    about after again against all also any because been before being between
    both but can do does each even every further had has have her here him his
    how if into its just me more most much my no not now off once one only
    other our out over own rather same she should since so some still such than
    their them then there these they this those through too under up very via
    we well what when where which while who why will without would you your
    """.split()
)

#: Fixed values: (category, pattern, rate per thousand words, floor).
TELLS = [
    (
        "7  AI vocabulary",
        r"(?iU)\b(delve|elevat\w+|seamless\w*|testament|tapestry|nestled|crucial|pivotal|leverag\w+|robust|meticulous\w*|curat(?:e|ed|ing|ion)|realm|landscape|unlock\w*|journey|embark|myriad|plethora|bespoke|artisanal|game-chang\w+|cutting-edge|state-of-the-art|holistic|synerg\w+)\b",
        6,
        1,
    ),
    ("4  promotional language", r"(?iU)\b(finest|world-class|unparalleled|premier|ultimate|exceptional|unrivall?ed|best-in-class|top-tier|second to none)\b", 2, 0),
    ("5  vague attribution", r"(?iU)\b(experts? (?:say|agree|believe)|(?:widely|generally) (?:regarded|considered|known)|many believe|it is believed|studies show|research suggests)\b", 0, 0),
    ("3  superficial -ing analysis", r"(?iU),\s+(?:highlighting|showcasing|reflecting|underscoring|emphasi[sz]ing|demonstrating|solidifying|cementing|ensuring)\b", 2, 0),
    ("9  negative parallelism", r"(?iU)\b(?:not (?:just|only|merely)|isn'?t (?:just|only|merely)|more than (?:just|simply))\b", 2, 0),
    ("1  inflated significance", r"(?iU)\b(?:stands as|serves as) a (?:testament|reminder|symbol)\b|\b(?:marks|represents) a (?:turning point|milestone|new era)\b", 1, 0),
    ("12 false range", r"(?iU)\bfrom \w+ to \w+,\s", 3, 1),
    ("18 emoji", r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", 0, 0),
    ("19 curly quotes", r"[“”‘’]", 40, 10),
    ("33 rhetorical opener", r"(?iU)(?:^|[.!?]\s+)(?:Honestly\?|Look,|Here'?s the thing|The thing is|Let'?s be honest|Real talk|But here'?s|Turns out,)", 1, 0),
    ("32 aphorism formula", r"(?iU)\bis the (?:language|currency|architecture|backbone|lifeblood) of\b|\bis not (?:a|just a) \w+,? but (?:a|an)\b|\bbecomes? a trap\b", 1, 0),
]
