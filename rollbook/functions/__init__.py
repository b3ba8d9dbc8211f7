"""Native column expressions. Null and blank are one value: inputs may be either, string outputs are never null."""
