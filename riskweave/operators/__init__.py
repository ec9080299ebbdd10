"""DataFrame operators.  Every function takes and returns a DataFrame; grouping
keys (sex, period, stratum) are passed as ``by=[...]`` so one plan serves all groups."""
