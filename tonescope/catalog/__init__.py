"""Every query of the inventory, with the same question in plain SQL where SQL can express it."""
