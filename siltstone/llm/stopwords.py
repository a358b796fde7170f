"""Frequent function words, by language. Fixed values."""

STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their there they this to was we were which will with would you".split(),
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so um und von war wird zu zum zur über".split(),
    "es": "al como con de del el ella en entre es esta este fue ha hasta la las lo los más no o para pero por que se ser si sin sobre son su sus también un una y ya".split(),
}
ALL = frozenset(w for words in STOP_WORDS.values() for w in words)
