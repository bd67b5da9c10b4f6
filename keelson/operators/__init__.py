"""keelson sub-package."""
