"""Part of loomset; see the README for what each module holds."""
