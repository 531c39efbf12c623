"""The reports a user runs, and the views that present and change them."""
