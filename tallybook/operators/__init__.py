"""Building blocks of the reports: scopes, joins, counter accounts, running totals, checks, edits."""
