"""DataFrame operators: designs, timelines, rates, reshaping, rejection, summaries, densities, hospital tables."""
