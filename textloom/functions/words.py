"""Stop words, as the behaviour that is matched has them. Two lists: lexical similarity drops more words than term extraction does."""

TERM_STOP_WORDS = frozenset(
    """a all also an and are as at be been both but by can could dare did do does each every few for from had has have he here how i in is it its just
    may might more most must need no nor not now of on only or other ought own same shall she should so some such than that the there these they this
    those to too used very was we were what when where which who whom whose why will with would you""".split()
)
LEXICAL_STOP_WORDS = (TERM_STOP_WORDS - {"every", "whose"}) | frozenset(
    """about above across after again against along already although any around away back because before being below between down during even further
    her hers herself him himself his if into itself many me much my myself off once our ours ourselves out over still their theirs them themselves then
    though through under until up upon while yet your yours yourself yourselves am""".split()
)
