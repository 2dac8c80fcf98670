"""Rule chains for sports and kinds of markets, and the tree of categories, on the family of a ticker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values from here to TREE: rules in the order in which they are tried; the first that matches decides.
_TENNIS = "(?:ATP|WTA|DAVISCUP|WMENSINGLES|WWOMENSINGLES|USOMENSINGLES|USOWOMENSINGLES|FOMENSINGLES|FOWOMENSINGLES|FOMEN|FOWOMEN)"
_GOLF = "(?:PGA|MASTERS|USOPEN|THEOPEN|GENESISINVITATIONAL|LIV)"
_SOCCER = "(?:EPL|PREMIERLEAGUE|UCL|UEFACL|LALIGA|SERIEA|BUNDESLIGA|LIGUE1|MLS|NWSL|FIFA|CLUBWC|EFLCHAMPIONSHIP|EFLCUP|UEL|SUPERLIG|EREDIVISIE|LIGAPORTUGAL|BRASILEIRO|MENWORLDCUP|BALLONDOR)"
_ESPORTS = "(?:COD|CS2|CSGO|DOTA2|LOL|OW|R6|VALORANT)"
SPORTS = [
    ("wnba", "^WNBA[A-Z0-9]*$"),
    ("nfl", "^(?:NFL[A-Z0-9]*|MVENFL[A-Z0-9]*|NFC|AFC|SB)$"),
    ("nba", "^(?:NBA[A-Z0-9]*|MVENBA[A-Z0-9]*)$"),
    ("mlb", "^MLB[A-Z0-9]*$"),
    ("ncaa_football", "^(?:NCAAF|HEISMAN)[A-Z0-9]*$"),
    ("ncaa_basketball", "^(?:NCAAMB|NCAAWB|MARMAD|WMARMAD)[A-Z0-9]*$"),
    ("nhl", "^NHL[A-Z0-9]*$"),
    ("tennis", f"^{_TENNIS}[A-Z0-9]*$"),
    ("golf", f"^{_GOLF}[A-Z0-9]*$"),
    ("soccer", f"^{_SOCCER}[A-Z0-9]*$"),
    ("ufc_boxing", "^(?:UFC|BOXING)[A-Z0-9]*$"),
    ("racing", "^(?:F1|NASCAR|INDYCAR|INDY500)[A-Z0-9]*$"),
    ("esports", f"^(?:{_ESPORTS}[A-Z0-9]*|IEM[A-Z0-9]*|LEAGUEWORLDS|INTERNETINVITATIONAL|MVESPORTS[A-Z0-9]*)$"),
    ("other_sports", "^(?:NATHAN|EUROLEAGUE)[A-Z0-9]*$"),
]
MIXED = "^MVE[A-Z0-9]*$"
KINDS = [
    ("futures", "^[A-Z0-9]*(?:WINS|MVP|ROTY|POTY|COTY|PLAYOFF|STAGEOFELIM|DRAFT|REGTOP|APRANK|TOPAPRANK|ADVANCE|FINALS|FINALSQUAL|TOURNWIN|NEXTTEAM|NEXTCONTRACT|TRADE|ALLTEAM|ALLDEFENSE|SERIES|HRDERBY)[A-Z0-9]*$"),
    ("futures", "^[A-Z0-9]*CHAMP(?:ION|IONS|IONSHIP)?$"),
    ("futures", "^(?:NFC|AFC|SB|HEISMAN|BALLONDOR|WMENSINGLES|WWOMENSINGLES|USOMENSINGLES|USOWOMENSINGLES|FOMENSINGLES|FOWOMENSINGLES|FOMEN|FOWOMEN|MASTERS|USOPEN|THEOPEN|GENESISINVITATIONAL|LIVTOUR|PGATOUR|PGARYDER|MENWORLDCUP)$"),
    ("futures", "^(?:CS2|VALORANT|LEAGUEWORLDS|IEM[A-Z0-9]*)$"),
    ("futures", "^(?:NFL(?:NFC|AFC)(?:WEST|EAST|NORTH|SOUTH)|NBA(?:EAST|WEST)|NHL(?:EAST|WEST)|MLB(?:AL|NL)(?:EAST|WEST|CENTRAL)?)$"),
    ("futures", "^(?:UCL|UEL)[A-Z0-9]*ROUND[A-Z0-9]*$"),
    ("futures", f"^(?:NFLMATCHUP[A-Z0-9]*|{_SOCCER}[A-Z0-9]*(?:TOP4|TEAMPOINTS)[A-Z0-9]*)$"),
    ("team_props", "^[A-Z0-9]*TEAMTOTAL[A-Z0-9]*$"),
    ("team_props", f"^{_SOCCER}[A-Z0-9]*(?:BTTS|SCORE)[A-Z0-9]*$"),
    ("team_props", "^(?:NBAH2HBENCHPTS|NASCARTOPTEAM|MLBRFI|MLBEXTRAS|NFLGAMESPECIALS|NFLTSPEC|PGARYDERCUPD1)$"),
    ("spread", "^[A-Z0-9]*SPREAD[A-Z0-9]*$"),
    ("score_total", "^[A-Z0-9]*TOTAL[A-Z0-9]*$"),
    ("player_props", "^NFL(?:2TD|ANYTD|FIRSTTD|PASSYDS|REC|RECYDS|RSHYDS)[A-Z0-9]*$"),
    ("player_props", "^(?:NBA|WNBA)(?:2D|3D|3PT|AST|BLK|PTS|PTSLEADER|REB|STL|PRA)[A-Z0-9]*$"),
    ("player_props", "^MLB(?:HIT|HILT|HR|HRLR|HRR|KS|OUTS|RBI|SB|TB)[A-Z0-9]*$"),
    ("player_props", "^NHL(?:AST|FIRSTGOAL|GOAL|PTS)[A-Z0-9]*$"),
    ("player_props", "^(?:ATP|WTA)(?:ACES|EXACTMATCH)[A-Z0-9]*$"),
    ("player_props", f"^{_SOCCER}[A-Z0-9]*(?:FIRSTGOAL|GOAL)[A-Z0-9]*$"),
    ("player_props", f"^{_GOLF}[A-Z0-9]*(?:BOGEYFREE|HOLESCORE|MAKECUT|ROUND|TOP|LEADER)[A-Z0-9]*$"),
    ("player_props", "^(?:F1|NASCAR|INDYCAR)[A-Z0-9]*(?:FASTESTLAP|RACEPODIUM|PODIUM|POLE|TOP20)[A-Z0-9]*$"),
    ("player_props", "^(?:BOXING(?:DISTANCE|KNOCKOUT)|UFC(?:VICROUND|MOV))[A-Z0-9]*$"),
    ("moneyline", "^NFLGAME$"),
    ("moneyline", "^(?:NBA|WNBA)(?:GAME|(?:SUMMER)?(?:1H|2H|[1-4]Q)WINNER)$"),
    ("moneyline", "^MLB(?:GAME|F3|F5|ASGAME)$"),
    ("moneyline", "^NHLGAME$"),
    ("moneyline", "^NCAAFGAME$"),
    ("moneyline", "^(?:NCAAMB|NCAAWB)(?:GAME|D3GAME|(?:1H|2H|[1-4]Q)WINNER)$"),
    ("moneyline", "^(?:(?:ATP|WTA)(?:CHALLENGER)?MATCH|(?:ATP|WTA)DOUBLES|(?:ATP|WTA)S[0-9]+GWINNER|(?:ATP|WTA)SETWINNER|DAVISCUPMATCH)$"),
    ("moneyline", "^(?:UFCFIGHT|BOXING)$"),
    ("moneyline", "^(?:F1RACE|NASCARRACE|INDYCARRACE|NASCARH2H)$"),
    ("moneyline", "^(?:PGAH2H|PGA3BALL|PGARYDERMATCH)$"),
    ("moneyline", f"^{_SOCCER}[A-Z0-9]*GAME$"),
    ("moneyline", "^EUROLEAGUEGAME$"),
    ("moneyline", "^(?:COD(?:GAME|MAP)|CS2(?:GAME|MAP)|CSGOGAME|DOTA2(?:GAME|MAP)|LOL(?:GAME|GAMES|MAP)|OWGAME|R6GAME|VALORANT(?:GAME|MAP))$"),
]
TEXTS = [
    ("futures", "(^|[^A-Z0-9])(?:MVP|ROOKIE OF THE YEAR|CHAMPIONSHIP|MAKE THE PLAYOFFS|REGULAR SEASON WINS|TOURNAMENT WINNER)([^A-Z0-9]|$)"),
    ("team_props", "(^|[^A-Z0-9])(?:TEAM TOTAL|BOTH TEAMS TO SCORE|EXACT SCORE)([^A-Z0-9]|$)"),
    ("spread", "(^|[^A-Z0-9])SPREAD([^A-Z0-9]|$)"),
    ("score_total", "(^|[^A-Z0-9])(?:OVER/UNDER|TOTAL (?:POINTS|RUNS|GOALS))([^A-Z0-9]|$)"),
    ("player_props", "(^|[^A-Z0-9])(?:PASSING|RUSHING|RECEIVING) YARDS([^A-Z0-9]|$)"),
    ("moneyline", "(^|[^A-Z0-9])(?:WHO WILL WIN|GAME WINNER|MATCH WINNER|FIGHT WINNER|RACE WINNER)([^A-Z0-9]|$)"),
]
#: The part of the tree of categories that the mapped families need, in its order; a whole tree is passed as a parameter.
TREE = [
    ("NFLGAME", "Sports", "NFL", "Games"),
    ("NFL", "Sports", "NFL", "Other NFL"),
    ("NBATOTAL", "Sports", "NBA", "Totals"),
    ("NBASPREAD", "Sports", "NBA", "Spreads"),
    ("NBAMVP", "Sports", "NBA", "MVP"),
    ("NBA", "Sports", "NBA", "Other NBA"),
    ("MLBTOTAL", "Sports", "MLB", "Totals"),
    ("MLBSPREAD", "Sports", "MLB", "Spreads"),
    ("MLB", "Sports", "MLB", "Other MLB"),
    ("NCAAF", "Sports", "NCAA Football", "Other NCAAF"),
    ("NCAAMB", "Sports", "NCAA Basketball", "Other NCAAMB"),
    ("NHLGAME", "Sports", "NHL", "Games"),
    ("NHL", "Sports", "NHL", "Other NHL"),
    ("ATPMATCH", "Sports", "Tennis", "ATP Matches"),
    ("ATP", "Sports", "Tennis", "Other ATP"),
    ("WTA", "Sports", "Tennis", "Other WTA"),
    ("EPLGAME", "Sports", "Soccer", "EPL Games"),
    ("EPL", "Sports", "Soccer", "Other EPL"),
    ("UCL", "Sports", "Soccer", "Other UCL"),
    ("PRES", "Politics", "Presidential", "General"),
]


def family(ticker: Column) -> Column:
    """The part before the first '-', upper-cased, without KX."""
    return F.regexp_replace(F.split_part(F.upper(F.trim(ticker)), F.lit("-"), F.lit(1)), "^KX", "")


def first_match(value: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda rest, rule: F.when(value.rlike(rule[1]), rule[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def sport(ticker: Column) -> Column:
    return first_match(family(ticker), SPORTS)


def kind(ticker: Column, *texts: Column) -> Column:
    """The kind of market; none for mixed families. Texts decide where the family is unknown."""
    out = first_match(family(ticker), KINDS)
    if texts:
        joined = F.upper(F.trim(F.concat_ws(" ", *(F.coalesce(t.cast("string"), F.lit("")) for t in texts))))
        out = F.coalesce(out, first_match(joined, TEXTS))
    return F.when(family(ticker).rlike(MIXED), None).otherwise(out)


def category(event_ticker: Column) -> Column:
    """The leading capitals and digits; `independent` for none."""
    found = F.regexp_extract(F.coalesce(event_ticker, F.lit("")), "^([A-Z0-9]+)", 1)
    return F.when(found == "", "independent").otherwise(found)


def place(name: Column, tree: list[tuple[str, str, str, str]] = TREE) -> Column:
    """(group, category, subcategory) of the first pattern of the tree that stands in the name."""
    triple = lambda *x: F.struct(*(v.alias(n) for v, n in zip(x, ("group", "category", "subcategory"), strict=True)))
    rest = triple(F.lit("Other"), F.lit("Other"), name)
    for pattern, *where in reversed(tree):
        rest = F.when(F.upper(name).contains(pattern), triple(*map(F.lit, where))).otherwise(rest)
    return rest


def by_family(rows: DataFrame, ticker: str, **columns) -> DataFrame:
    """rows with columns worked out once for each distinct family (`<family>-`) and joined back."""
    key = F.split_part(F.upper(F.trim(F.coalesce(ticker, F.lit("")))), F.lit("-"), F.lit(1))
    keyed = rows.withColumn("__family", key)
    known = keyed.select("__family").distinct().select("__family", *(make(F.col("__family")).alias(n) for n, make in columns.items()))
    return keyed.join(known, "__family").drop("__family")


def first_match_sql(value: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{n}'" for n, p in rules) + " END"


def family_sql(ticker: str) -> str:
    return f"regexp_replace(split_part(upper(trim({ticker})), '-', 1), '^KX', '')"


def kind_sql(ticker: str) -> str:
    return f"CASE WHEN regexp_matches({family_sql(ticker)}, '{MIXED}') THEN NULL ELSE {first_match_sql(family_sql(ticker), KINDS)} END"


def place_sql(name: str, level: int) -> str:
    """level: 1 group, 2 category, 3 subcategory."""
    rest = name if level == 3 else "'Other'"
    return "CASE " + " ".join(f"WHEN contains(upper({name}), '{row[0]}') THEN '{row[level]}'" for row in TREE) + f" ELSE {rest} END"
