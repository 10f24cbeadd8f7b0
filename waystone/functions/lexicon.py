"""Word lists, patterns and constants that decide results."""

from __future__ import annotations

# Fixed values. Street words: the full form, then its short forms. The first
# short form may also be written with a trailing period.
STREET_TYPES = """
drive dr
road rd
avenue ave av
street st
court ct
lane ln
boulevard blvd bvd
place pl
circle cir
trail trl tr
parkway pkwy
terrace ter
way wy
highway hwy
pike pk
alley aly
annex anx
expressway expy
extension ext
freeway fwy
grove grv
heights hts
junction jct
landing lndg
loop lp
point pt
square sq
trace trce
view vw
"""

DIRECTIONS = """
north n
south s
east e
west w
northeast ne
northwest nw
southeast se
southwest sw
"""

# Fixed values. Suffixes spelled out when a full address is built.
SUFFIXES = """
DR Drive
RD Road
AVE Avenue
AV Avenue
ST Street
CT Court
LN Lane
BLVD Boulevard
NW Northwest
SW Southwest
NE Northeast
SE Southeast
N North
S South
E East
W West
PL Place
CIR Circle
TRL Trail
PKWY Parkway
TER Terrace
WY Way
HWY Highway
PIKE Pike
ALY Alley
ANX Annex
EXPY Expressway
EXT Extension
FWY Freeway
GRV Grove
HTS Heights
JCT Junction
LNDG Landing
LOOP Loop
PT Point
SQ Square
TRCE Trace
VW View
"""

# Fixed values. State and territory codes.
STATE_CODES = """
AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO
MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY
DC PR VI GU AS
""".split()

# Fixed values. Patterns of the address grammar.
UNIT_PATTERN = (
    r"(?i)[,\s]*#\s*[a-zA-Z0-9]+"
    r"|[,\s]+(?:apt|apartment|ste|suite|unit|bldg|building|fl|floor|rm|room)\b\.?\s*"
    r"(?:#\s*[a-zA-Z0-9]+|\d+[a-zA-Z]?\b|[a-zA-Z]\b)"
)
DOUBLE_COMMA = r"\s*,\s*,\s*"
SPACE_RUN = r"\s{2,}"
ZIP_AT_END = r"\b(\d{5})(?:-\d{4})?\s*\z"
HOUSE_AT_START = r"^(\d+[a-zA-Z]?(?:-\d+)?)\s+"

# Fixed values. All characters that count as white space when trimming.
WS = (
    r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]"
)
# The same characters, one by one.
WS_CHARS = " \t\n\v\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Fixed values. Path fragment -> endpoint category, first match wins.
ENDPOINTS = [
    ("/geocode/", "geocode"),
    ("/distance/", "distance"),
    ("/nearby/", "nearby"),
    ("/proximity/", "proximity"),
    ("/search", "search"),
    ("/addresses", "addresses"),
    ("/counties", "counties"),
    ("/cities", "cities"),
    ("/states", "states"),
    ("/admin/", "admin"),
]

# Fixed values. Endpoint category -> permission a key needs for it.
PERMISSIONS = {
    "geocode": "geocode",
    "search": "search",
    "distance": "distance",
    "nearby": "distance",
    "proximity": "distance",
    "addresses": "addresses",
    "counties": "counties",
    "cities": "cities",
    "states": "states",
    "admin": "admin",
}

# Fixed values. Plan -> (monthly limit, daily limit); -1 is unlimited.
PLAN_LIMITS = {
    "free": (3000, 500),
    "starter": (30000, 5000),
    "pro": (500000, 100000),
    "enterprise": (-1, -1),
}
DEFAULT_PLAN_LIMITS = (3000, 500)

# Fixed values. Distance constants.
EARTH_MILES = 3959.0
KM_PER_MILE = 1.60934
MILES_PER_DEGREE = 69.0
EARTH_KM = 6371.0
MEAN_EARTH_KM = 6371.0088

# Fixed values. (default, cap, rule) of the row limits; "clamp" cuts down to the
# cap, "reset" goes back to the default when the value is out of range.
ROW_LIMITS = {
    "addresses": (50, 500, "clamp"),
    "cities": (10, 100, "clamp"),
    "zips": (50, 100, "reset"),
    "nearby": (50, 200, "reset"),
    "states": (50, None, "reset"),
    "counties": (100, 1000, "reset"),
    "datasets": (50, None, "reset"),
    "days": (30, 365, "reset"),
}


def word_forms(table: str) -> dict[str, list[str]]:
    """Every spelling -> all spellings of the same word."""
    forms: dict[str, list[str]] = {}
    for line in table.split("\n"):
        if line:
            full, short, *rest = line.split()
            spellings = [full, short, f"{short}.", *rest]
            forms.update({word: spellings for word in spellings})
    return forms


def suffix_words() -> dict[str, str]:
    return dict(line.split() for line in SUFFIXES.split("\n") if line)
