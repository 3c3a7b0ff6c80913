"""Plans that join operators to whole stages."""
