"""Session settings, shared-folder helpers, whole workflows and plan
inspection."""
