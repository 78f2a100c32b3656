"""Column functions: patterns, spans, filters and scores. No shuffles, no Python workers except where said."""
