"""The default stop list; a corpus brings its own as a file of one word a line."""

#: Common English function words.
STOP_WORDS = frozenset(
    """a about above after again against all also am among an and another any are as at be became because been before
    being below between both but by can could did do does doing down during each either else ever every few first for
    from further get had has have having he her here hers herself him himself his how however i if in into is it its
    itself just last less many may me might more most much must my myself neither no nor not now of off often on once
    one only or other our ours ourselves out over own per quite rather said same say see she should since so some
    still such t than that the their theirs them themselves then there these they this those though through thus to
    too toward two under until up upon us very was we were what when where whether which while who whom whose why will
    with within without would yet you your yours yourself yourselves""".split()
)
