"""Jobs on whole tables: upserts, change tests, contracts, differences, layouts and serving queries."""
