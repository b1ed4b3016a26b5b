"""The rule language, its rewrites and its lowering to one DataFrame."""
