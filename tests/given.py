"""Where the given tables are."""

ROOT = "/root/testdata/sf0.001"
