"""The analysis as a whole, its reports and its registered queries."""
