"""Composed study plans over the fixture tables (the queries registered in
``__spark_entry__``).  Each function takes (spark, sf_dir) and returns a lazy
DataFrame; a few run small bounded summary jobs while planning."""
