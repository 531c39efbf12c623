"""Where the small tables of the training-data tests are."""

SMALL = "/root/testdata/sf0.001"
